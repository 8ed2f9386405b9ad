"""Near-duplicate records with small edits: anchor-point covering.

A set is fingerprinted by minhash values, in ``GROUPS`` groups of ``POINTS`` values in the field of ``PRIME`` elements. The
anchors of a group are the codewords of the Reed-Solomon code of dimension ``DIMENSION``: the polynomials of lower degree,
taken at ``POINTS`` places. As the code is maximum distance separable, it covers the whole space with radius
POINTS - DIMENSION, and two fingerprints at that distance (the threshold) from each other agree at DIMENSION places, hence lie
within the radius of one anchor. So a fingerprint goes to the anchors within the covering radius, C(POINTS, DIMENSION) in a
group: every anchor that radius plus threshold would add is one where only pairs beyond the threshold meet.

Sets that meet at an anchor are compared there: their ids pair up, in blocks where very many meet, so no task has all pairs of
a hot anchor, and every pair that met is compared exactly, on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: A pair of similarity 0.7 meets in a group with 0.652, so it is missed by all 18 once in 170 million; closer pairs far less.
GROUPS, POINTS, DIMENSION, PRIME, SEED = 18, 4, 3, 2**31 - 1, 20240607
#: Ids in a block of a hot anchor, and windows from which on a set is held in rows.
BLOCK_IDS, TALL = 512, 20_000


def _minhashes(w: pa.ListArray) -> np.ndarray:
    """Values of ``GROUPS * POINTS`` minhash functions (rows) over each list; no list is empty."""
    rng = np.random.default_rng(SEED)
    n = GROUPS * POINTS
    mult = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    flat = w.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(w).to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
    least = np.empty((n, len(w)), np.uint64)
    for i in range(n):
        h = flat * mult[i] + add[i]
        h ^= h >> np.uint64(32)
        least[i] = np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), starts) >> np.uint64(20)
    return least


def _anchors(least: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """(anchor, class_id) of every anchor of each group within the covering radius."""
    p = np.uint64(PRIME)
    values = least % p
    inverse = lambda v: pow(int(v) % PRIME, -1, PRIME)
    for g in range(GROUPS):
        y = values[g * POINTS : (g + 1) * POINTS]
        for chosen in combinations(range(POINTS), DIMENSION):
            # coefficients of the polynomial through the chosen places, by Lagrange's basis
            coefficients = [np.zeros(len(ids), np.uint64) for _ in range(DIMENSION)]
            for i in chosen:
                basis, scale = [1], 1
                for j in chosen:
                    if j != i:
                        basis = [(basis[k - 1] if k else 0) - j * (basis[k] if k < len(basis) else 0) for k in range(len(basis) + 1)]
                        scale = scale * (i - j)
                for k in range(DIMENSION):
                    factor = np.uint64(basis[k] * inverse(scale) % PRIME)
                    coefficients[k] = (coefficients[k] + y[i] * factor % p) % p
            code = np.full(len(ids), g + 1, np.uint64)
            for c in coefficients:
                code = (code ^ c) * np.uint64(0xFF51AFD7ED558CCD)
                code ^= code >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), ids], names=["anchor", "class_id"])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, windows) to (anchor, class_id)."""
    for b in batches:
        if len(b):
            yield from _anchors(_minhashes(b.column(1)), b.column(0))


def _partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, part of the windows) to (class_id, minhash values of the part)."""
    for b in batches:
        if len(b):
            least = _minhashes(b.column(1)).T.astype(np.int64)
            offsets = pa.array(np.arange(len(b) + 1) * least.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(least.ravel()))], names=["class_id", "least"])


def _anchored_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, minhash values of the whole set) to (anchor, class_id)."""
    for b in batches:
        if len(b):
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), GROUPS * POINTS)
            yield from _anchors(values.T.astype(np.uint64), b.column(0))


def _meetings(block: int):
    """(anchor, class_id) sorted by anchor to (left, right): lists of ids, each pair of which met; hot anchors in many blocks."""

    def rows(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for ids in groups:
            parts = [ids[i : i + block] for i in range(0, len(ids), block)]
            for i, a in enumerate(parts):
                for b in parts[i:]:
                    left.append(a)
                    right.append(b)
                    if len(left) * block > 1_000_000:
                        yield batch(left, right)
                        left, right = [], []
        if left:
            yield batch(left, right)

    def batch(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
        sides = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (left, right)]
        return pa.RecordBatch.from_arrays(sides, names=["left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, waiting = None, []
        for b in batches:
            if not len(b):
                continue
            x, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.append(cuts, len(x))
            if x[0] != anchor:
                yield from rows([np.concatenate(waiting)] if sum(map(len, waiting)) > 1 else [])
                waiting = []
            anchor = x[-1]
            if len(starts) == 1:  # the anchor goes on
                waiting.append(ids)
                continue
            first = np.concatenate([*waiting, ids[: ends[0]]])
            several = np.flatnonzero(ends - starts > 1)
            yield from rows([g for g in [first, *(ids[starts[i] : ends[i]] for i in several if 0 < i < len(starts) - 1)] if len(g) > 1])
            waiting = [ids[starts[-1] :]]
        yield from rows([np.concatenate(waiting)] if sum(map(len, waiting)) > 1 else [])

    return run


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (``name, class_id``) and one set a class (``class_id, windows``); a class holds the equal sets.

    ``sets`` has ``name, windows array<bigint>``, the windows distinct and sorted. Equal sets are told by 64 bits of hash
    and their size.
    """
    keyed = sets.withColumn("class_id", F.xxhash64("windows", F.size("windows")))
    return keyed.select("name", "class_id"), keyed.groupBy("class_id").agg(F.first("windows").alias("windows"))


def tall_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of sets too large for a row, ``name, window`` (distinct): membership, and ``class_id, n, window``."""
    bits = [F.bit_xor(F.xxhash64("window", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    keyed = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *bits).select("name", F.xxhash64("n", "x1", "x2").alias("class_id"), "n")
    one = keyed.groupBy("class_id").agg(F.min("name").alias("name"), F.first("n").alias("n"))
    return keyed.select("name", "class_id"), rows.join(one, "name").select("class_id", "n", "window")


def _tall_anchors(tall: DataFrame, part: int) -> DataFrame:
    """Anchors of sets given in rows: minhash values of parts of at most some ``part`` windows, then the least of them."""
    parts = tall.groupBy("class_id", F.pmod("window", F.ceil(F.col("n") / part)).alias("part")).agg(F.collect_list("window").alias("windows"))
    least = parts.select("class_id", "windows").mapInArrow(_partly, "class_id bigint, least array<bigint>")
    each = least.select("class_id", F.posexplode("least").alias("pos", "v")).groupBy("class_id", "pos").agg(F.min("v").alias("v"))
    whole = each.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("least"))
    return whole.mapInArrow(_anchored_values, "anchor bigint, class_id bigint")


def _shared_by_rows(pairs: DataFrame, one: DataFrame, tall: DataFrame, buckets: int = 64) -> DataFrame:
    """``a, b, na, nb, shared`` of the pairs with a set in rows, joined by class and bucket of the window."""
    large = written(tall.select(F.col("class_id").alias("large")).distinct())
    some = written(pairs.join(large, F.col("a") == F.col("large"), "left_semi").unionByName(pairs.join(large, F.col("b") == F.col("large"), "left_semi")).distinct())
    ends = some.select(F.col("a").alias("class_id")).unionByName(some.select(F.col("b").alias("class_id"))).distinct()
    short = one.join(ends, "class_id", "left_semi").select("class_id", F.size("windows").cast("long").alias("n"), F.explode("windows").alias("window"))
    every = written(short.unionByName(tall.join(ends, "class_id", "left_semi")).withColumn("bucket", F.pmod("window", F.lit(buckets))))
    x = every.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "window", "bucket")
    y = every.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "window", "bucket")
    spread = some.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return spread.join(x, ["a", "bucket"]).join(y, ["b", "window", "bucket"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))


def similar_classes(one: DataFrame, similarity: float, tall: DataFrame | None = None, block: int = BLOCK_IDS, part: int = TALL) -> DataFrame:
    """``a, b, shared, united`` (class ids, a < b) of the classes whose sets have at least that Jaccard similarity.

    ``one`` has ``class_id, windows``; ``tall`` the classes whose sets are given in rows, from ``tall_classes``.
    """
    anchors = one.select("class_id", "windows").mapInArrow(_anchored, "anchor bigint, class_id bigint")
    if tall is not None:
        anchors = anchors.unionByName(_tall_anchors(tall, part))
    met = anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_meetings(block), "left array<bigint>, right array<bigint>")
    met = met.repartition(F.xxhash64("left", "right"))  # the blocks of a hot anchor leave its task before they are paired
    pairs = met.select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y")).where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if tall is not None:
        pairs = written(pairs)
    x = one.select(F.col("class_id").alias("a"), F.col("windows").alias("wa"))
    y = one.select(F.col("class_id").alias("b"), F.col("windows").alias("wb"))
    sized = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("wa").cast("long").alias("na"), F.size("wb").cast("long").alias("nb"), F.size(F.array_intersect("wa", "wb")).cast("long").alias("shared"))
    if tall is not None:
        sized = sized.unionByName(_shared_by_rows(pairs, one, tall))
    united = F.col("na") + F.col("nb") - F.col("shared")
    return sized.select("a", "b", "shared", united.alias("united")).where(F.col("shared") * 1_000_000 >= F.lit(round(similarity * 1_000_000)) * united)


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``name_a, name_b`` (name_a < name_b) of linked classes and of one class."""
    a = members.select(F.col("class_id").alias("a"), F.col("name").alias("na"))
    b = members.select(F.col("class_id").alias("b"), F.col("name").alias("nb"))
    across = pairs.select("a", "b").join(a, "a").join(b, "b")
    within = a.join(b, (F.col("a") == F.col("b")) & (F.col("na") < F.col("nb")))
    return across.select("na", "nb").unionByName(within.select("na", "nb")).select(F.least("na", "nb").alias("name_a"), F.greatest("na", "nb").alias("name_b"))
