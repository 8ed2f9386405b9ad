"""Encoding of texts with a public byte-level tokenizer: the distinct-word table.

Spark splits the texts to words by the tokenizer's own pattern and counts them; each distinct word is encoded once. The
most frequent words, at most ``HOT_WORDS`` of bounded length, go to every task as a dictionary, so nearly all words of a
text get their ids where the text is read, and a word that makes up a third of the collection moves nowhere. The other
words keep their place in the text and get their ids by a join. Ids are turned back by a join with the table of pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import WHITE
from ..sources.shared import written

HOT_WORDS, HOT_LENGTH = 50_000, 64
VOCABULARY = "byte_bpe_50k.tiktoken"
_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE)
#: Fixed value: the pattern that splits text before the merges, with white space written out as the JVM's ``\s`` is ASCII only.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_CLASS}\p{{L}}\p{{N}}]+|[{_CLASS}]+(?![^{_CLASS}])|[{_CLASS}]+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def words(text: Column | str) -> Column:
    """The words of a text, in order; joined they are the text. None for a null or empty text."""
    return F.regexp_extract_all(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))


def _encode(merges: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        whole = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=merges, special_tokens={})
        for b in batches:
            ids = whole.encode_ordinary_batch(b.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), b.column(1)], names=["word", "ids", "n"])

    return run


def word_table(texts: DataFrame, path: str | None = None) -> DataFrame:
    """``word, ids, n`` of every distinct word of ``text``, written to the shared folder."""
    counted = texts.select(F.explode(words("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.mapInArrow(_encode(ranks(path or vocabulary_path())), "word string, ids array<int>, n bigint"))


def _look_up(hot: list[str], ids: list[list[int]], counts_only: bool):
    """(row, doc_id, words) to (row, doc_id, ids or their number, the words not in the dictionary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(hot, pa.string())
        sizes = np.array([len(i) for i in ids] + [1], np.int64)  # a word to be looked up elsewhere holds one place
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.array([x for i in ids for x in i] + [-1], np.int32)
        for b in batches:
            w = b.column(2)
            word = w.flatten()
            at = pc.fill_null(pc.index_in(word, known), len(hot)).to_numpy(zero_copy_only=False).astype(np.int64)
            per_text = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(per_text)])
            n = sizes[at]
            before = np.concatenate([[0], np.cumsum(n)])
            rare = at == len(hot)
            rare_before = np.concatenate([[0], np.cumsum(rare)])
            missing = pa.ListArray.from_arrays(pa.array(rare_before[ends].astype(np.int32)), word.filter(pa.array(rare)))
            if counts_only:
                made = pa.array((before[ends[1:]] - before[ends[:-1]]) - (rare_before[ends[1:]] - rare_before[ends[:-1]]))
            else:
                place = np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])
                made = pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), pa.array(flat[place]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made, missing], names=["row", "doc_id", "made", "missing"])

    return run


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the ids of the looked-up words to their places."""
    for b in batches:
        out = []
        for made, found in zip(b.column(1), b.column(2).to_pylist()):
            a = made.values.to_numpy()
            gaps = np.flatnonzero(a < 0)
            parts, last = [], 0
            for g, ids in zip(gaps, found):
                parts += [a[last:g], np.asarray(ids, np.int32)]
                last = g + 1
            out.append(np.concatenate([*parts, a[last:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _looked_up(documents: DataFrame, path: str | None, counts_only: bool, hot_words: int) -> tuple[DataFrame, DataFrame]:
    """Each text with what the dictionary gave, and the ids of its other words in order."""
    table = word_table(documents.select("text"), path)
    hot = table.where(F.length("word") <= HOT_LENGTH).orderBy(F.desc("n"), "word").limit(hot_words).select("word", "ids").collect()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", words("text").alias("words"))
    kind = "bigint" if counts_only else "array<int>"
    look = _look_up([r[0] for r in hot], [r[1] for r in hot], counts_only)
    met = written(rows.mapInArrow(look, f"row bigint, doc_id {documents.schema['doc_id'].dataType.simpleString()}, made {kind}, missing array<string>"))
    value = F.size("ids") if counts_only else F.col("ids")
    places = met.where("size(missing) > 0").select("row", F.posexplode("missing").alias("pos", "word")).join(table, "word").select("row", "pos", value.alias("v"))
    if counts_only:
        return met, places.groupBy("row").agg(F.sum("v").alias("more"))
    return met, places.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("found"))


def encoded(documents: DataFrame, path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id, ids array<int>`` of every row of ``documents`` (``doc_id, text``), without special tokens.

    A null and an empty text give an empty list. Rows are kept as they are, repeated ones too. ``path`` is a file of
    base64 pieces and ranks.
    """
    met, found = _looked_up(documents, path, False, hot_words)
    whole = met.where("size(missing) = 0").select("doc_id", F.col("made").alias("ids"))
    parts = met.where("size(missing) > 0").join(found, "row").select("doc_id", "made", "found")
    return whole.unionByName(parts.mapInArrow(_fill, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>"))


def token_counts(documents: DataFrame, path: str | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """``row, doc_id, n_tokens`` of every row of ``documents``; ``row`` is unique."""
    met, more = _looked_up(documents, path, True, hot_words)
    return met.join(more, "row", "left").select("row", "doc_id", (F.col("made") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``id, piece binary``: the vocabulary, as many rows as it has entries."""
    made = pa.table({"id": pa.array([*(r := ranks(path or vocabulary_path())).values()], pa.int32()), "piece": pa.array([*r], pa.binary())})
    return spark.createDataFrame(made)


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``: pieces joined by id (the vocabulary is broadcast: its size is fixed), put in order."""
    rows = written(ids.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids"))
    # whole lists are spread by row, so what is exploded and put together again below isn't shuffled a second time
    placed = rows.repartition("row").select("row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(pieces(ids.sparkSession, path)), "id")
    texts = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("p"))
    texts = texts.select("row", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8").alias("text"))
    return rows.select("row", "doc_id").join(texts, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
