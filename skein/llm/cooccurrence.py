"""Items that appear together: stripes.

Items that can't be in any pair asked for are left out first. A map task keeps, per item, an associative array of the later
items met in the same record, and sends it as a stripe. A stripe is cut by a hash of its neighbours, so an item that meets
everything is spread over several tasks. Where stripes of one item and cut arrive, their arrays are merged, and the merged
counts are tested by lift and by the log-likelihood ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Cuts of a stripe, places and pairs held by a map task, and bits of the set of items to be paired (16 MB at most).
CUTS, HELD_PLACES, HELD_PAIRS, MOST_BITS = 16, 500_000, 2_000_000, 27
#: The 95 % quantile of chi-squared with one degree of freedom.
SIGNIFICANT = 3.841
STRIPE = pa.schema([("item", pa.string()), ("cut", pa.int32()), ("neighbours", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_DDL = "item string, cut int, neighbours array<string>, counts array<bigint>"


def _stripe_batches(items: pa.Array, a: np.ndarray, b: np.ndarray, n: np.ndarray, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of the counted pairs (a, b), codes of ``items``; ``cut`` is that of each code."""
    order = np.lexsort((b, cut[b], a))
    a, b, n = a[order], b[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (cut[b[1:]] != cut[b[:-1]])])) if len(a) else np.empty(0, np.int64)
    for i in range(0, len(new), 20_000):
        starts = new[i : i + 20_000]
        end = new[i + 20_000] if i + 20_000 < len(new) else len(a)
        offsets = pa.array(np.append(starts, end) - starts[0], pa.int32())
        inside = slice(starts[0], end)
        yield pa.RecordBatch.from_arrays(
            [items.take(pa.array(a[starts])), pa.array(cut[b[starts]], pa.int32()), pa.ListArray.from_arrays(offsets, items.take(pa.array(b[inside]))), pa.ListArray.from_arrays(offsets, pa.array(n[inside], pa.int64()))], schema=STRIPE
        )


def _stripes(common: list[str], able: bytes, bits: int, cuts: int, held_places: int, held_pairs: int):
    def kept(items: pa.Array) -> np.ndarray:
        c = np.array([crc32(x.encode()) for x in items.to_pylist()], np.int64) & ((1 << bits) - 1)
        inside = np.frombuffer(able, np.uint8)[c >> 3] >> (c & 7) & 1
        return (inside == 1) & ~pc.is_in(items, pa.array(common, pa.string())).to_numpy(zero_copy_only=False)

    def flush(lists: list[pa.ListArray]) -> Iterator[pa.RecordBatch]:
        w = pa.chunked_array(lists, pa.list_(pa.string())).combine_chunks()
        if isinstance(w, pa.ChunkedArray):
            w = w.combine_chunks()
        coded = w.flatten().dictionary_encode()
        items = coded.dictionary
        if not len(items):
            return
        x = coded.indices.to_numpy().astype(np.int64)
        use = kept(items)[x]
        x, record = x[use], pc.list_parent_indices(w).to_numpy()[use]
        cut = np.array([crc32(i.encode()) % cuts for i in items.to_pylist()], np.int32)
        counted: list[tuple[np.ndarray, np.ndarray]] = []

        def count(codes: list[np.ndarray]) -> None:
            if codes:
                counted.append(np.unique(np.concatenate(codes), return_counts=True))

        at, codes, n, g = np.arange(len(x)), [], 0, 0
        while len(at):  # the g-th next item of the same record; a place without one has none further on
            g += 1
            at = at[at + g < len(x)]
            at = at[record[at] == record[at + g]]
            codes.append(x[at] * len(items) + x[at + g])
            n += len(at)
            if n > held_pairs:
                count(codes)
                codes, n = [], 0
        count(codes)
        for code, times in counted:
            yield from _stripe_batches(items, code // len(items), code % len(items), times, cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, places = [], 0
        for b in batches:
            lists.append(b.column(0))
            places += len(b.column(0).flatten())
            if places > held_places:
                yield from flush(lists)
                lists, places = [], 0
        if lists:
            yield from flush(lists)

    return run


def _merge(least: int):
    """Stripes sorted by item and cut, merged array by array; only the last key's array waits for the next batch."""

    def merged(t: pa.Table) -> pa.Table:
        return t.group_by(["item", "cut", "neighbour"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["item", "cut", "neighbour", "n"])

    def given(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.filter(pc.greater_equal(t.column("n"), least)).select(["item", "neighbour", "n"]).rename_columns(["item_a", "item_b", "n_ab"])
        yield from t.to_batches(50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for b in batches:
            if not len(b):
                continue
            row = pc.list_parent_indices(b.column(2))
            t = pa.table({"item": b.column(0).take(row), "cut": b.column(1).take(row), "neighbour": b.column(2).flatten(), "n": b.column(3).flatten()})
            t = merged(t if waiting is None else pa.concat_tables([waiting, t]).combine_chunks())
            last = pc.and_(pc.equal(t.column("item"), b.column(0)[-1]), pc.equal(t.column("cut"), b.column(1)[-1]))
            waiting = t.filter(last)
            yield from given(t.filter(pc.invert(last)))
        if waiting is not None:
            yield from given(waiting)

    return run


def _set_of(items: DataFrame, bits: int) -> bytes:
    """A set of ``bits`` bits of hash of the column ``item``: a fixed size, whatever the number of items."""
    c = F.crc32(F.col("item").cast("binary")).bitwiseAND((1 << bits) - 1)
    parts = items.select(c.alias("c")).groupBy(F.shiftright("c", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("c").bitwiseAND(32767)).alias("bits")).collect()
    made = bytearray(max(1 << bits - 3, 4096))
    for part, some in parts:
        made[part << 12 : (part + 1) << 12] = some
    return bytes(made)


def _xlogx(c):
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))


def together(records: DataFrame, min_count: int = 5, min_lift: float = 4.0, min_llr: float = SIGNIFICANT, cuts: int = CUTS, held_places: int = HELD_PLACES, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """``item_a, item_b, n_ab, n_a, n_b, n, lift, llr`` of the pairs with ``n_ab >= min_count``, ``lift >= min_lift`` and
    ``llr >= min_llr``.

    ``records`` has one row per record with ``items array<string>``. Null items don't count, repeats count once; records
    without an item aren't in ``n``. ``item_a < item_b`` by code points. ``lift`` is n_ab over the number expected by chance,
    ``llr`` the log-likelihood ratio of the 2x2 table, at least 2 n_ab (log(lift) - 1 + 1 / lift): from 5 common records and
    a lift of 4 on it is at least 6.3, so the default significance takes nothing there.

    Items in so many records that no partner could reach the lift (fewer than ``min_lift`` times the mean items a record) are
    left out before pairing, and so are items in too few records, by a set of hash bits that may let some of them through;
    those are told by the exact counts at the end. Both follow from the thresholds, so no pair is lost.
    """
    sets = written(records.select(F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).where("size(items) > 0"))
    n = sets.count()
    single = written(sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= min_count))
    too_many = F.col("n_item") * F.lit(float(min_lift)) > n
    able = single.where(~too_many)
    common = [r[0] for r in single.where(too_many).select("item").collect()]
    bits = min(MOST_BITS, max(15, (8 * single.count()).bit_length()))
    stripes = sets.where("size(items) > 1").mapInArrow(_stripes(common, _set_of(able, bits), bits, cuts, held_places, held_pairs), _DDL)
    pairs = stripes.repartition("item", "cut").sortWithinPartitions("item", "cut").mapInArrow(_merge(min_count), "item_a string, item_b string, n_ab bigint")
    pairs = pairs.join(able.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), "item_a").join(able.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), "item_b")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    pairs = pairs.withColumn("n", F.lit(n).cast("long")).where(big("n_ab") * big("n") >= F.lit(min_lift).cast("decimal(9,3)") * (big("n_a") * big("n_b")).cast("decimal(28,0)"))
    a, b, ab, m = (F.col(c).cast("double") for c in ("n_a", "n_b", "n_ab", "n"))
    llr = 2 * (_xlogx(ab) + _xlogx(a - ab) + _xlogx(b - ab) + _xlogx(m - a - b + ab) + _xlogx(m) - _xlogx(a) - _xlogx(m - a) - _xlogx(b) - _xlogx(m - b))
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", (ab * m / (a * b)).alias("lift"), llr.alias("llr")).where(F.col("llr") >= min_llr)
