"""Frequent subsequences with gaps: finite-state transducer mining.

The constraints are compiled to a transducer over item ids: ids are given by falling support, an infrequent item is a
blank, and a step of the transducer goes from one item to another 1 to ``max_gap`` places on if that pair is frequent
itself. For each sequence and each pivot (the least frequent item of a pattern), the candidate patterns of the sequence
are the paths of an acyclic automaton. It is compressed to the states that lie on an accepted path, each as its label and
its distance from the state before, so sequences with the same candidates give the same bytes and are merged to one
weighted automaton. Automata are shuffled by pivot, in parts for a pivot that has very many, and mined where they arrive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows in a block of a long sequence; places, and paths, that a task holds; parts of a pivot; names that may be broadcast;
#: frequent items that are mined as automata.
BLOCK, CHUNK_PLACES, CHUNK_PATHS, PARTS, BROADCAST_NAMES, MOST_ITEMS = 1024, 1_000_000, 2_000_000, 64, 100_000, 2048


def ordered_blocks(rows: DataFrame, values: Column, overlap: int, block: int = BLOCK) -> DataFrame:
    """``name, long, values``: each name's values by (step_no, step_id), in blocks of the values of ``block`` rows.

    ``rows`` has ``name, step_no, step_id`` and what ``values`` (an array column) needs; rows without a name or a value are
    left out, redelivered equal rows count once, a null step_no orders first, equal step numbers order by step_id. A name of
    at most ``block`` rows, as nearly all are, is one row. For others, ``long`` is the name (else null), and each block is
    followed by the first ``overlap`` values of the next ones, so every run of ``overlap + 1`` values lies in one row. Their
    rows are numbered in ranges of (name, step_no, step_id), so no name is collected or sorted by one task, not even one whose
    step numbers are all null or equal.
    """
    rows = rows.where("name is not null")
    placed = rows.select("name", F.coalesce(F.col("step_no"), F.lit(-1)).alias("n"), "step_id", values.alias("v")).where("size(v) > 0")

    def joined(df: DataFrame, order: list[str], collect, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(collect(F.struct(*order, "v"))), lambda s: s["v"])).alias("values"))

    tall = written(rows.groupBy("name").count().where(F.col("count") > block).select("name"))
    n_tall = tall.count()
    if not n_tall:
        return joined(placed, ["n", "step_id"], F.collect_set, "name").select("name", F.lit(None).cast("string").alias("long"), "values")
    known = F.broadcast(tall) if n_tall <= BROADCAST_NAMES else tall
    short = joined(placed.join(known, "name", "left_anti"), ["n", "step_id"], F.collect_set, "name")
    order = ["n", "step_id", "v"]
    ranged = written(placed.join(known, "name", "left_semi").distinct().repartitionByRange("name", *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = ranged.groupBy("name", "range").count().select("name", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("name", "range").orderBy(*order)) - 1
    numbered = ranged.withColumn("nth", nth).join(offsets, ["name", "range"]).select("name", (F.col("nth") + F.col("offset")).alias("nth"), "v")
    made = written(joined(numbered.withColumn("block", F.floor(F.col("nth") / block)), ["nth"], F.collect_list, "name", "block"))
    following = Window.partitionBy("name").orderBy("block").rowsBetween(1, overlap)
    heads = made.select("name", "block", F.slice("values", 1, overlap).alias("h"))
    heads = heads.select("name", "block", F.slice(F.flatten(F.collect_list("h").over(following)), 1, overlap).alias("next"))
    long = made.join(heads, ["name", "block"]).select("name", F.col("name").alias("long"), F.concat("values", "next").alias("values"))
    return short.select("name", F.lit(None).cast("string").alias("long"), "values").unionByName(long)


def _encoded(column: pa.ListArray, items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0: blank) and the sequence number of each place."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ids = pc.fill_null(pc.add(pc.index_in(column.flatten(), items), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _tables(batches: Iterator[pa.RecordBatch], sizes) -> Iterator[pa.Table]:
    """Batches put together, or cut, to tables of about ``CHUNK_PLACES`` places; ``sizes`` gives the places of each row."""
    kept, n = [], 0
    for b in batches:
        ends = np.cumsum(sizes(b))
        at = 0
        while at < len(b):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK_PLACES - n, "right")))
            kept.append(b.slice(at, to - at))
            n += int(ends[to - 1]) - done
            at = to
            if n >= CHUNK_PLACES or at < len(b):
                yield pa.Table.from_batches(kept)
                kept, n = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _lengths(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(b.column(b.schema.get_field_index("values"))), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _states(b: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(b.column(b.schema.get_field_index("states"))).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def _pairs(items: list[str], max_gap: int):
    """Support of each ordered pair of items within the gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, width = pa.array(items, pa.string()), len(items) + 1
        total = np.zeros(width * width, np.int64)
        for t in _tables(batches, _lengths):
            x, s = _encoded(t.column("values"), words)
            seen = [np.empty(0, np.int64)]
            for g in range(1, max_gap + 1):
                ok = (s[:-g] == s[g:]) & (x[:-g] > 0) & (x[g:] > 0)
                seen.append(((s[:-g] * width + x[:-g]) * width + x[g:])[ok])
            found = np.unique(np.concatenate(seen)) % (width * width)
            total += np.bincount(found, minlength=width * width)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return run


def _live(x: np.ndarray, s: np.ndarray, pivot: int, allowed: np.ndarray, max_gap: int, lengths: tuple[int, ...]) -> np.ndarray:
    """Places on a path of an accepted length that goes through the pivot. x: ids, 0 where not to be used."""
    most, n = max(lengths), len(x)
    steps = []
    for g in range(1, min(max_gap, n - 1) + 1):
        steps.append((g, (s[:-g] == s[g:]) & allowed[x[:-g], x[g:]]))

    def reach(back: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        plain, through = [x > 0], [x == pivot]
        for _ in range(most - 1):
            a, b = np.zeros(n, bool), np.zeros(n, bool)
            for g, ok in steps:
                if back:
                    a[:-g] |= plain[-1][g:] & ok
                    b[:-g] |= through[-1][g:] & ok
                else:
                    a[g:] |= plain[-1][:-g] & ok
                    b[g:] |= through[-1][:-g] & ok
            plain.append(a)
            through.append(b | (a & (x == pivot)))
        return plain, through

    ends, ends_p = reach(False)
    begins, begins_p = reach(True)
    live = np.zeros(n, bool)
    for length in lengths:
        for before in range(length):
            after = length - 1 - before
            live |= (ends_p[before] & begins[after]) | (ends[before] & begins_p[after])
    return live


def _automata(items: list[str], allowed: np.ndarray, max_gap: int, lengths: tuple[int, ...]):
    """Weighted automata of each sequence and pivot: (pivot, owner, states, weight); a state is label, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(items, pa.string())
        for t in _tables(batches, _lengths):
            x, s = _encoded(t.column("values"), words)
            owner = t.column("long").combine_chunks()
            place = np.arange(len(x))
            for pivot in range(1, len(items) + 1):
                has = np.zeros(len(t), bool)
                has[s[x == pivot]] = True
                use = has[s]
                if not use.any():
                    continue
                xs, ss, ps = np.where(x[use] <= pivot, x[use], 0), s[use], place[use]
                live = _live(xs, ss, pivot, allowed, max_gap, lengths)
                xs, ss, ps = xs[live], ss[live], ps[live]
                if not len(xs):
                    continue
                first = np.concatenate([[True], ss[1:] != ss[:-1]])
                gap = np.where(first, 0, np.minimum(np.diff(ps, prepend=0), max_gap + 1))
                states = np.stack([xs, gap], 1).astype("<u2").tobytes()
                starts = np.flatnonzero(first)
                offsets = np.append(starts, len(xs)).astype(np.int32) * 4
                made = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(states)])
                merged = pa.table({"owner": owner.take(pa.array(ss[starts])), "states": made}).group_by(["owner", "states"]).aggregate([([], "count_all")])
                n = len(merged)
                yield from pa.table({"pivot": pa.array(np.full(n, pivot, np.int32)), "owner": merged.column("owner"), "states": merged.column("states"), "weight": pc.cast(merged.column("count_all"), pa.int64())}).to_batches()

    return run


def _mine(width: int, allowed: np.ndarray, max_gap: int, lengths: tuple[int, ...]):
    """Patterns of weighted automata, each counted once an automaton: (owner, code, weight)."""

    def paths(x: np.ndarray, a: np.ndarray, at: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(automaton, pattern code) of every path, distinct."""
        src, dst = [], []
        for o in range(1, max_gap + 1):
            ok = np.flatnonzero((a[:-o] == a[o:]) & (at[o:] - at[:-o] <= max_gap) & allowed[x[:-o], x[o:]])
            src.append(ok)
            dst.append(ok + o)
        src, dst = np.concatenate(src), np.concatenate(dst)
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        lo, hi = np.searchsorted(src, np.arange(len(x))), np.searchsorted(src, np.arange(len(x)), "right")
        end, code, top, found = dst, x[src] * width + x[dst], np.maximum(x[src], x[dst]), []
        auto = a[src]
        for length in range(2, max(lengths) + 1):
            if length in lengths:
                hit = top == pivot[auto]
                found.append(np.stack([auto[hit], code[hit]], 1))
            if length < max(lengths):
                n = hi[end] - lo[end]
                back = np.repeat(np.arange(len(end)), n)
                nth = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n)
                end = dst[lo[end][back] + nth]
                code, top, auto = code[back] * width + x[end], np.maximum(top[back], x[end]), auto[back]
        both = np.concatenate(found)
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        new = np.concatenate([[True], (np.diff(both, axis=0) != 0).any(1)]) if len(both) else np.empty(0, bool)
        return both[new, 0], both[new, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for t in _tables(batches, _states):
            states = t.column("states").combine_chunks()
            sizes = pc.binary_length(states).to_numpy().astype(np.int64) // 4
            flat = np.frombuffer(b"".join(states.to_pylist()), "<u2").reshape(-1, 2).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            weight, pivot, owner = t.column("weight").to_numpy(), t.column("pivot").to_numpy().astype(np.int64), t.column("owner").to_pylist()
            own = np.array([o is not None for o in owner], bool)
            step = max(1, CHUNK_PATHS // max_gap ** (max(lengths) - 1))
            i = 0
            while i < len(sizes):  # so many automata that the paths fit in memory
                j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, "right")) - 1)
                part = flat[bounds[i] : bounds[j]]
                auto = np.repeat(np.arange(j - i), sizes[i:j])
                if len(part) > 1:
                    k, code = paths(part[:, 0], auto, np.cumsum(part[:, 1]), pivot[i:j])
                    common = ~own[i:j][k]
                    codes, inverse = np.unique(code[common], return_inverse=True)
                    for c, w in zip(codes.tolist(), np.bincount(inverse, weight[i:j][k[common]]).astype(np.int64).tolist()):
                        sums[c] = sums.get(c, 0) + w
                    if not common.all():
                        yield pa.RecordBatch.from_arrays([pa.array([owner[i + q] for q in k[~common]], pa.string()), pa.array(code[~common]), pa.array(np.ones((~common).sum(), np.int64))], names=["owner", "code", "n"])
                i = j
            if len(sums) > 500_000:
                yield _batch(sums)
                sums = {}
        yield _batch(sums)

    def _batch(sums: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(sums), pa.string()), pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], names=["owner", "code", "n"])

    return run


def _by_joins(blocks: DataFrame, frequent: DataFrame, max_gap: int, lengths: tuple[int, ...], least: int, n: int) -> DataFrame:
    """The same patterns where very many items are frequent: paths grown place by place, only those of frequent patterns."""
    rows = written(blocks.select(F.monotonically_increasing_id().alias("seq"), "long", "values"))
    placed = written(rows.select("seq", "long", F.posexplode("values").alias("pos", "item")).join(frequent.select("item"), "item", "left_semi"))
    nexts = placed.select("seq", F.col("pos").alias("at"), F.col("item").alias("next"))
    paths, found = placed.select("seq", "long", "pos", F.array("item").alias("items")), []
    for length in range(2, max(lengths) + 1):
        moved = paths.select("seq", "long", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + max_gap)).alias("at"), "items").join(nexts, ["seq", "at"])
        moved = written(moved.select("seq", "long", F.col("at").alias("pos"), F.concat("items", F.array("next")).alias("items")))
        owner = F.struct("long", F.when(F.col("long").isNull(), F.col("seq")).alias("seq"))
        held = moved.select(owner.alias("owner"), "items").distinct().groupBy("items").agg(F.count(F.lit(1)).alias("n_sequences")).where(F.col("n_sequences") >= least)
        held = written(held)
        paths = moved.join(held.select("items"), "items", "left_semi")
        found += [held] if length in lengths else []
    every = reduce(DataFrame.unionByName, found)
    return every.select("items", "n_sequences", (F.col("n_sequences") / F.lit(float(max(n, 1)))).alias("share"))


def frequent_subsequences(blocks: DataFrame, max_gap: int = 5, lengths: tuple[int, ...] = (3, 4), min_count: int = 8, min_share: float = 0.025, parts: int = PARTS) -> DataFrame:
    """``items array<string>, n_sequences, share`` of the patterns that enough sequences hold.

    ``blocks`` comes from ``ordered_blocks`` with an overlap of ``max_gap * (max(lengths) - 1)``. A sequence holds a pattern
    if its items stand there in order, each 1 to ``max_gap`` places after the one before. Enough: ``min_count`` and
    ``min_share`` of the sequences with at least ``min(lengths)`` places. Exact: support only falls as patterns grow, so
    blanking infrequent items and pairs loses none. Of the item list, at most mean distinct items a sequence / ``min_share``
    long, ``MOST_ITEMS`` go to the driver; where more are frequent, paths are grown by joins. Without sequences there are no patterns.
    """
    blocks = written(blocks.where(F.size("values") > 0))
    none = blocks.select(F.col("values").alias("items"), F.lit(0).cast("long").alias("n_sequences"), F.lit(0.0).alias("share")).limit(0)
    short = blocks.where("long is null")
    n = short.where(F.size("values") >= min(lengths)).count()
    tall = blocks.where("long is not null")
    has_long = tall.limit(1).count() > 0
    if has_long:
        n += tall.groupBy("long").agg(F.sum(F.size("values")).alias("n")).where(F.col("n") >= min(lengths)).count()
    least = max(min_count, -(-int(round(min_share * 1e6)) * n // 1_000_000))
    support = short.select(F.explode(F.array_distinct("values")).alias("item"))
    if has_long:
        support = support.unionByName(tall.select("long", F.explode(F.array_distinct("values")).alias("item")).distinct().select("item"))
    items = [r[0] for r in support.groupBy("item").count().where(F.col("count") >= least).orderBy(F.desc("count"), "item").limit(MOST_ITEMS + 1).collect()]
    if not items:
        return none
    width = len(items) + 1
    if width > MOST_ITEMS or width ** max(lengths) >= 2**62:  # beyond what tables of pairs and 64-bit codes hold
        return _by_joins(blocks, support.groupBy("item").count().where(F.col("count") >= least), max_gap, lengths, least, n)
    pairs = blocks.select("values").mapInArrow(_pairs(items, max_gap), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    allowed = np.zeros(width * width, bool)
    allowed[[r[0] for r in pairs.select("code").collect()]] = True  # at most len(items) squared
    allowed = allowed.reshape(width, width)
    automata = blocks.select("long", "values").mapInArrow(_automata(items, allowed, max_gap, lengths), "pivot int, owner string, states binary, weight bigint")
    weighted = automata.withColumn("part", F.pmod(F.xxhash64("states"), F.lit(parts))).repartition("pivot", "part").groupBy("pivot", "part", "owner", "states").agg(F.sum("weight").alias("weight"))
    mined = weighted.select("owner", "pivot", "states", "weight").mapInArrow(_mine(width, allowed, max_gap, lengths), "owner string, code bigint, n bigint")
    if has_long:  # a long sequence counts once, whatever number of blocks hold the pattern
        mined = mined.groupBy("owner", "code").agg(F.sum("n").alias("n")).select("code", F.when(F.col("owner").isNull(), F.col("n")).otherwise(1).alias("n"))
    kept = mined.groupBy("code").agg(F.sum("n").alias("n_sequences")).where(F.col("n_sequences") >= least)
    digits = [F.floor(F.col("code") / F.lit(width**k)) % width for k in range(max(lengths) - 1, -1, -1)]
    named = F.transform(F.filter(F.array(*digits), lambda d: d > 0), lambda d: F.element_at(F.array(*map(F.lit, items)), d.cast("int")))
    return kept.select(named.alias("items"), "n_sequences", (F.col("n_sequences") / F.lit(float(max(n, 1)))).alias("share"))
