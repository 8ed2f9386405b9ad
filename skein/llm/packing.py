"""Filling containers of fixed capacity: a configuration linear program over the length histogram.

Only the histogram (at most ``capacity`` rows, however many items) goes to the driver. There, the program "cover every
length with configurations, using few" is solved by multiplicative weights (``program``): a round prices all lengths at once by
knapsack dynamic programming, takes the configurations that are worth nearly as much as the best one, and lowers the price of
each length by a factor with the share of its demand that they cover. Every round's prices give a lower bound of any packing, the
dual; the program ends when the cover it has found is within ``GAP`` of the bound.

The cover is rounded by halves (``dived``): its most used configurations are used a whole number of times, and the program is solved
again for what is left, so no item is placed in another way. First ``stepped`` tries whole steps at the starting prices: a round
cuts the open lengths at random into groups of ``GROUP`` and uses each group's best configuration as often as its scarcest
length allows. Where lengths are many and smooth that meets the bound at once, and the bound proves it; otherwise the packing
with fewer containers is kept. Each use exhausts a length or halves what is left of it, so the number of configurations goes with
the number of lengths and not of items. The plan says, for each length, which ranks go to which containers, and Spark ranks the
items of a length in buckets, so no length is sorted by one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

CAPACITY, GROUP, RATE, SEED, BUCKET_ITEMS = 2048, 20, 0.02, 11, 100_000
GAP, STEP, FINER, ROUNDS, DIVE_ROUNDS, COLUMNS, PASSES, LEAST_PRICE = 0.001, 0.1, 0.75, 128, 32, 300, 60, 1e-12


def priced(sizes: np.ndarray, values: np.ndarray, capacity: int, limits: np.ndarray) -> tuple[np.ndarray, list]:
    """The most that each room up to ``capacity`` can hold, and the choices made, to be followed by ``followed``."""
    best = np.zeros(capacity + 1)
    taken = []
    for k in range(len(sizes)):
        left, times = min(int(limits[k]), capacity // int(sizes[k])), 1
        while left > 0:  # 1, 2, 4 and so on of it, and the rest, make any number
            m = min(times, left)
            w = m * int(sizes[k])
            gain = best[:-w] + m * values[k]
            better = gain > best[w:]
            np.maximum(best[w:], gain, out=best[w:])
            taken.append((k, m, w, better))
            left, times = left - m, times * 2
    return best, taken


def followed(held: np.ndarray, room: np.ndarray, taken: list) -> np.ndarray:
    """``held``, a configuration a row, with the best that fits into each row's ``room`` added."""
    for k, m, w, better in reversed(taken):
        fits = np.flatnonzero(room >= w)
        fits = fits[better[room[fits] - w]]
        held[fits, k] += m
        room[fits] -= w
    return held


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int, limits: np.ndarray) -> np.ndarray:
    """How many of each size the best configuration holds, at most ``limits`` of each; sizes are positive."""
    _, taken = priced(sizes, values, capacity, limits)
    held = np.zeros(len(sizes), np.int64)
    c = capacity
    for k, m, w, better in reversed(taken):
        if c >= w and better[c - w]:
            held[k] += m
            c -= w
    return held


def start(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Prices to begin with: the sizes, or with short ones free and long ones (no others fit beside them) a whole container, by the demand's worth."""
    best = plain = sizes / capacity
    for short in range(0, capacity // 2 + 1, max(1, capacity // 256)):
        price = np.where(sizes > capacity - short, 1.0, np.where(sizes < short, 0.0, plain))
        if demand @ price > (1 + 1e-9) * (demand @ best):
            best = price
    return best


def program(sizes: np.ndarray, demand: np.ndarray, capacity: int, price: np.ndarray, rounds: int, enough: float = np.inf) -> tuple[float, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Least number of containers, the prices that prove it, configurations and how often each is used, by multiplicative weights.

    It ends when the cover is within ``GAP`` of the bound, when the bound has reached ``enough``, or after ``rounds``. The bound
    is the demand at the prices over the worth of the best configuration, so it holds after any number of rounds.
    """
    rng = np.random.default_rng(SEED)
    limits = np.minimum(demand, capacity // sizes)
    bound, proof, known, configs = 0.0, price, set(), []
    used, covered, step = np.zeros(0), np.zeros(len(sizes)), STEP
    for n in range(rounds):
        if n & (n - 1) == 0:  # what the prices of the first half led to is forgotten, and steps get finer
            used, covered, step = np.zeros(len(configs)), np.zeros(len(sizes)), step * FINER
        best, taken = priced(sizes, price, capacity, limits)
        most = best[capacity]
        if demand @ price / most > bound:
            bound, proof = float(demand @ price / most), price
        if bound >= enough:
            break
        # besides the best configuration, the best that hold one of a length, where they are worth nearly as much
        near = np.flatnonzero(price + best[capacity - sizes] >= (1 - step) * most)
        near = rng.choice(near, COLUMNS, False) if len(near) > COLUMNS else near
        held = np.zeros((len(near) + 1, len(sizes)), np.int64)
        held[np.arange(1, len(near) + 1), near] = 1
        held = followed(held, np.concatenate([[capacity], capacity - sizes[near]]), taken)
        for row in held[(held <= limits).all(1)]:
            at = np.flatnonzero(row)
            key = at.tobytes() + row[at].tobytes()
            if key not in known:
                known.add(key)
                configs.append((at, row[at]))
        used = np.concatenate([used, np.zeros(len(configs) - len(used))])
        lengths = np.array([len(at) for at, _ in configs])
        first, of = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(configs)), lengths)
        at, many = np.concatenate([a for a, _ in configs]), np.concatenate([m for _, m in configs])
        share = many / demand[at]
        once = 1e-3 / np.maximum.reduceat(share, first)
        for _ in range(PASSES):  # prices only fall, so what is worth nearly the most stays so
            good = np.add.reduceat(price[at] * many, first) >= (1 - step) * most
            if not good.any():
                break
            more = np.where(good, np.maximum(used, once), 0.0)
            cover = np.bincount(at, share * more[of], len(sizes))
            scale = 1 / cover.max()
            used, covered = used + scale * more, covered + scale * cover
            price = price * np.exp(-step * scale * cover)
        price = np.maximum(price / price.max(), LEAST_PRICE * sizes)  # one that has vanished couldn't rise again
        if used.sum() <= (1 + GAP) * bound * covered.min():
            break
    return bound, proof, configs, used


def stepped(sizes: np.ndarray, demand: np.ndarray, capacity: int, worth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Whole steps only: configurations of groups of lengths, each used as often as its scarcest length allows."""
    rng = np.random.default_rng(SEED)
    left, steps = demand.copy(), []
    while (left > 0).any():
        open_ = rng.permutation(np.flatnonzero(left))
        for g in np.array_split(open_, -(-len(open_) // GROUP)):
            price = worth[g] * np.exp(-RATE * (1 - left[g] / demand[g]))
            held = knapsack(sizes[g], price, capacity, left[g])
            at, many = g[held > 0], held[held > 0]
            times = int((left[at] // many).min())
            left[at] -= many * times
            steps.append((at, many, times))
    return steps


def dived(sizes: np.ndarray, left: np.ndarray, capacity: int, price: np.ndarray, solved: tuple) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The cover of ``solved`` in whole numbers: its most used half, then the program again for the demand that is left."""
    left, steps, open_ = left.copy(), [], np.arange(len(sizes))
    while True:
        bound, _, configs, used = solved
        used, placed = used * bound / used.sum(), 0
        for c in np.argsort(-used, kind="stable"):
            if used[c] < 1 and placed >= bound / 2:
                break
            at, many = open_[configs[c][0]], configs[c][1]
            times = min(max(1, int(used[c])), int((left[at] // many).min()))
            if times > 0:
                left[at] -= many * times
                placed += times
                steps.append((at, many, times))
        open_ = np.flatnonzero(left)
        if not len(open_):
            return steps
        solved = program(sizes[open_], left[open_], capacity, price[open_], DIVE_ROUNDS)


def solved(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], float]:
    """Configurations that cover every length exactly, and the bound: ((places of the lengths, how many of each, how often), least number)."""
    if not len(sizes):
        return [], 0.0
    first = start(sizes, demand, capacity)
    # a little of the size keeps every price above zero, so that weights can move it
    price = 0.9 * first + 0.1 * sizes / capacity
    steps = stepped(sizes, demand, capacity, price)
    count = sum(times for *_, times in steps)
    enough = min(count / (1 + GAP), count - 1 + 1e-6)
    bound = program(sizes, demand, capacity, first, 1, 0.0)[0]
    if bound < enough:
        found = program(sizes, demand, capacity, price, ROUNDS, enough)
        bound = max(bound, found[0])
        if bound < enough:
            other = dived(sizes, demand, capacity, found[1], found)
            steps = min(steps, other, key=lambda s: sum(times for *_, times in s))
    return steps, bound


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Configurations that cover every length exactly: (places of the lengths, how many of each, how often)."""
    return solved(sizes, demand, capacity)[0]


def dual_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """The least number of containers by the dual of the program that ``plan`` uses, all lengths priced at once."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    return int(np.ceil(solved(sizes, demand, capacity)[1] - 1e-6))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, ranks, first container, items of the size in a container), covering every item once. Sizes <= capacity."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    rank, rows, container = np.zeros(len(sizes), np.int64), [], 0
    for at, many, times in solve(sizes, demand, capacity):
        for i, m in zip(at.tolist(), many.tolist()):
            rows.append((int(sizes[i]), int(rank[i]), m * times, container, m))
            rank[i] += m * times
        container += times
    return rows


def pieces_of(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``row, doc_id, piece_no, first_token, size``: an item of at most ``capacity`` whole, a longer one in full pieces and a rest."""
    cut = F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity))
    made = items.where("n_tokens > 0").select("row", "doc_id", "n_tokens", F.explode(cut).alias("piece_no"))
    return made.select("row", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("size"))


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, first_token, n_tokens, container_id`` of ``row, doc_id, n_tokens`` (``row`` unique).

    Items of null, zero or negative size are left out. Containers are numbered from 0; none holds more than ``capacity``.
    """
    spark = items.sparkSession
    cut = written(pieces_of(items, capacity))
    histogram = {r[0]: r[1] for r in cut.groupBy("size").count().collect()}  # at most capacity rows
    buckets = max(1, sum(histogram.values()) // BUCKET_ITEMS)
    placed = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "piece_no"), F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")).select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "bucket").orderBy("row", "piece_no")
    ranked = placed.withColumn("nth", F.row_number().over(inside) - 1).join(offset, ["size", "bucket"]).withColumn("rank", F.col("nth") + F.col("offset"))
    rows = plan(histogram, capacity)
    # as many rows as configurations have lengths: bounded by the capacity, not by the items
    chosen = spark.createDataFrame(rows, "size int, first bigint, n bigint, container bigint, held bigint") if rows else spark.createDataFrame([], "size int, first bigint, n bigint, container bigint, held bigint")
    met = ranked.join(F.broadcast(chosen), (ranked["size"] == chosen["size"]) & (ranked["rank"] >= chosen["first"]) & (ranked["rank"] < chosen["first"] + chosen["n"]))
    container = F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("held"))
    return met.select("doc_id", "piece_no", "first_token", ranked["size"].alias("n_tokens"), container.alias("container_id"))
