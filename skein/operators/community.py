"""Modularity communities: Leiden on one machine for graphs of bounded size, distributed coarsening before it for others.

A graph of at most ``LOCAL_EDGES`` edges goes to one task. A larger one is first coarsened with DataFrames: nodes move in
alternating halves to the neighbouring community with the largest gain in modularity, and each community becomes one node,
until the graph is small enough. Labels are carried back level by level, and at each level nodes may move again, so a node
that joined early can leave a community that grew otherwise. In the end communities are cut to their connected parts.
"""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, written
from .graph import component_flags, connected_components, induced, largest_component, undirected_edges

LOCAL_EDGES, ITERATIONS, SEED, MOVES, REFINING, LEVELS = 2_000_000, 10, 42, 6, 3, 12
#: A node or community of more than this degree, and this share of all, is joined by broadcast: at most 1 / share rows.
HEAVY_DEGREE, HEAVY_SHARE = 10_000, 1e-4


def leiden(n: int, src: list[int], dst: list[int], weight: list[float], iterations: int = ITERATIONS, seed: int = SEED) -> list[int]:
    """Community of each node 0..n-1 of an undirected weighted graph (each edge once; loops allowed). Deterministic for a seed."""
    rng = random.Random(seed)
    label = list(range(n))
    for _ in range(iterations):
        before = label
        label = _pass(n, src, dst, weight, label, rng)
        if _same(before, label):
            break
    return _connected(n, src, dst, label)


def _same(a: list[int], b: list[int]) -> bool:
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def _adjacency(n: int, src: list[int], dst: list[int], weight: list[float]) -> tuple[list[dict[int, float]], list[float]]:
    near: list[dict[int, float]] = [{} for _ in range(n)]
    degree = [0.0] * n
    for a, b, w in zip(src, dst, weight):
        degree[a] += w
        degree[b] += w
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    return near, degree


def _pass(n: int, src: list[int], dst: list[int], weight: list[float], label: list[int], rng: random.Random) -> list[int]:
    """Local moving, refinement and aggregation until nothing changes; returns the labels of the original nodes."""
    node_of = list(range(n))  # original node -> node of the current, aggregated graph
    label = _dense(label)
    while True:
        near, degree = _adjacency(n, src, dst, weight)
        m2 = sum(degree) or 1.0
        label = _move(near, degree, m2, label, rng)
        if len(set(label)) == n:
            break
        fine = _refine(near, degree, m2, label, rng)
        k = max(fine) + 1
        if k == n:
            break
        merged: dict[tuple[int, int], float] = defaultdict(float)
        for a, b, w in zip(src, dst, weight):
            x, y = fine[a], fine[b]
            merged[(x, y) if x <= y else (y, x)] += w
        coarse = [0] * k
        for v in range(n):
            coarse[fine[v]] = label[v]
        node_of = [fine[v] for v in node_of]
        n, label = k, _dense(coarse)
        src, dst, weight = [e[0] for e in merged], [e[1] for e in merged], [*merged.values()]
    return [label[v] for v in node_of]


def _dense(label: list[int]) -> list[int]:
    seen: dict[int, int] = {}
    return [seen.setdefault(x, len(seen)) for x in label]


def _move(near: list[dict[int, float]], degree: list[float], m2: float, label: list[int], rng: random.Random) -> list[int]:
    label, total = label[:], defaultdict(float)
    for v, c in enumerate(label):
        total[c] += degree[v]
    order = list(range(len(near)))
    rng.shuffle(order)
    queue, waiting = deque(order), [True] * len(near)
    free = max(label, default=-1) + 1
    while queue:
        v = queue.popleft()
        waiting[v] = False
        own, k = label[v], degree[v]
        links: dict[int, float] = defaultdict(float)
        for u, w in near[v].items():
            links[label[u]] += w
        total[own] -= k
        best, gain = own, links.get(own, 0.0) - k * total[own] / m2
        for c, w in links.items():
            g = w - k * total[c] / m2
            if g > gain + 1e-12:
                best, gain = c, g
        if gain < -1e-12:
            best, free = free, free + 1
        total[best] += k
        if best != own:
            label[v] = best
            for u in near[v]:
                if label[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return _dense(label)


def _refine(near: list[dict[int, float]], degree: list[float], m2: float, label: list[int], rng: random.Random) -> list[int]:
    """Every community anew from single nodes: a node that is well connected to its community joins a part of it it links to."""
    n = len(near)
    fine, size, total = list(range(n)), [1] * n, degree[:]
    community = defaultdict(float)
    for v in range(n):
        community[label[v]] += degree[v]
    inside = [sum(w for u, w in near[v].items() if label[u] == label[v]) for v in range(n)]
    order = list(range(n))
    rng.shuffle(order)
    for v in order:
        if size[fine[v]] > 1 or fine[v] != v:
            continue
        k, all_ = degree[v], community[label[v]]
        if inside[v] < k * (all_ - k) / m2:
            continue
        links: dict[int, float] = defaultdict(float)
        for u, w in near[v].items():
            if label[u] == label[v]:
                links[fine[u]] += w
        best, gain = v, 0.0
        for c, w in links.items():
            g = w - k * total[c] / m2
            if c != v and g > gain + 1e-12:
                best, gain = c, g
        if best != v:
            total[best] += k
            total[v] -= k
            size[best] += 1
            size[v] -= 1
            fine[v] = best
    return _dense(fine)


def _connected(n: int, src: list[int], dst: list[int], label: list[int]) -> list[int]:
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in zip(src, dst):
        if label[a] == label[b]:
            parent[root(a)] = root(b)
    return _dense([root(v) for v in range(n)])


def _local(pdf: pd.DataFrame, seed: int = SEED, iterations: int = ITERATIONS) -> pd.DataFrame:
    """``part, src, dst, weight`` of one graph to ``part, name, community``; nodes are numbered by name, whatever the row order."""
    pdf = pdf.sort_values(["src", "dst"], kind="stable")
    names = sorted(set(pdf["src"]) | set(pdf["dst"]))
    at = {x: i for i, x in enumerate(names)}
    found = leiden(len(names), [at[x] for x in pdf["src"]], [at[x] for x in pdf["dst"]], pdf["weight"].tolist(), iterations, seed)
    return pd.DataFrame({"part": pdf["part"].iloc[0], "name": names, "community": pd.Series(found, dtype="int64")})


def _spread(left: DataFrame, right: DataFrame, key: str, degree: str, least: float) -> DataFrame:
    """``left`` joined to ``right`` (one row a key); keys of a high degree, few by their bound, don't shuffle ``left``."""
    heavy = F.broadcast(right.where(F.col(degree) > least))
    rest = left.join(F.broadcast(right.where(F.col(degree) > least).select(key)), key, "left_anti")
    return left.join(heavy, key).unionByName(rest.join(right.where(F.col(degree) <= least), key))


def _ends(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links in both directions without loops (``name, other, w``), and nodes (``name, k, m2``) with their degree and its sum over the part."""
    links = graph.where("src <> dst")
    both = links.select(F.col("src").alias("name"), F.col("dst").alias("other"), F.col("weight").alias("w"))
    both = written(both.unionByName(both.select(F.col("other").alias("name"), F.col("name").alias("other"), "w")))
    degrees = graph.select("part", F.col("src").alias("name"), "weight").unionByName(graph.select("part", F.col("dst").alias("name"), "weight"))
    degrees = degrees.groupBy("part", "name").agg(F.sum("weight").alias("k"))
    return both, written(degrees.join(F.broadcast(degrees.groupBy("part").agg(F.sum("k").alias("m2"))), "part"))  # a row a part


def _moved(both: DataFrame, state: DataFrame, moves: int) -> DataFrame:
    """``part, name, k, m2, c`` after so many half moves."""
    most, whole = state.agg(F.max("k"), F.sum("k")).first()
    least = max(HEAVY_DEGREE, HEAVY_SHARE * (whole or 0))
    for i in range(moves):
        near = state.select(F.col("name").alias("other"), "c", "k")
        placed = _spread(both, near, "other", "k", least) if (most or 0) > least else both.join(near, "other")
        half = F.pmod(F.xxhash64("name", F.lit(i)), F.lit(2)) == 0
        links = placed.where(half).groupBy("name", "c").agg(F.sum("w").alias("w"))
        mover = state.where(half).select("name", "k", "m2", F.col("c").alias("own"))
        stay = mover.select("name", F.col("own").alias("c"), F.lit(0.0).alias("w"))
        total = state.groupBy("c").agg(F.sum("k").alias("tot"))
        options = _spread(links.unionByName(stay).groupBy("name", "c").agg(F.sum("w").alias("w")).join(mover, "name"), total, "c", "tot", least)
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.col("m2")
        best = options.groupBy("name").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (F.col("c") == F.col("own")).alias("stay"), "c")).alias("b"))
        state, last = written(state.join(best, "name", "left").select("part", "name", "k", "m2", F.coalesce(F.col("b.c"), F.col("c")).alias("c"))), state
        if i:
            discard(last)
    return state


def _coarser(graph: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level: links, nodes with the community ``c`` each goes to, and the graph of the communities, loops kept."""
    both, nodes = _ends(graph)
    state = _moved(both, nodes.withColumn("c", F.col("name")), MOVES)
    a, b = state.select(F.col("name").alias("src"), F.col("c").alias("a")), state.select(F.col("name").alias("dst"), F.col("c").alias("b"))
    up = graph.join(a, "src").join(b, "dst").groupBy("part", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return both, state, written(up.agg(F.sum("weight").alias("weight")))


def _finer(levels: list[tuple[DataFrame, DataFrame]], found: DataFrame) -> DataFrame:
    """``name, community`` of the nodes of the first level, from those of the last: at each level, nodes may move again before
    the labels go further down, and communities are cut to their connected parts in the end."""
    for both, state in reversed(levels):
        above = found.select(F.col("name").alias("c"), F.col("community").alias("up"))
        state = _moved(both, written(state.join(above, "c").select("part", "name", "k", "m2", F.col("up").alias("c"))), REFINING)
        found = state.select("name", F.col("c").alias("community"))
    label = found.select(F.col("name").alias("node"), F.col("community").alias("c"))
    inner = both.join(label.withColumnRenamed("node", "name"), "name").join(label.select(F.col("node").alias("other"), F.col("c").alias("co")), "other").where("c = co and name < other")
    parts = connected_components(inner.select(F.col("name").alias("src"), F.col("other").alias("dst")), found.select("name"))
    return parts.select(F.col("node").alias("name"), F.col("component").alias("community"))


def communities(edges: DataFrame, local_edges: int = LOCAL_EDGES, seed: int = SEED, iterations: int = ITERATIONS, whole: bool = False) -> DataFrame:
    """``name, cid`` of the nodes of the largest component (``whole``: of all nodes with an edge); others have no row.

    ``edges`` has ``src, dst`` in any direction. Communities are numbered by falling size, ties by their least name.
    """
    graph = undirected_edges(edges)
    if not whole:
        graph = graph.join(largest_component(connected_components(edges)).select(F.col("node").alias("src")), "src", "left_semi")
    graph = written(graph.select(F.lit(0).alias("part"), "src", "dst", F.lit(1.0).alias("weight")))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for _ in range(LEVELS):
        n = graph.count()
        if n <= local_edges:
            break
        both, state, graph = _coarser(graph)
        levels.append((both, state))
        if graph.count() >= n:
            raise RuntimeError("communities: the graph doesn't get smaller; raise local_edges")
    found = graph.groupBy("part").applyInPandas(lambda pdf: _local(pdf, seed, iterations), "part int, name string, community bigint").select("name", F.col("community").cast("string").alias("community"))
    return numbered(written(_finer(levels, found) if levels else found))


def numbered(found: DataFrame) -> DataFrame:
    """``name, cid`` with communities numbered from 0 by falling size, ties by least name. One row a community is ranked."""
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"))
    rank = sizes.select("community", (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).cast("int").alias("cid"))
    return found.join(rank, "community").select("name", "cid")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``modularity`` of an undirected graph (each edge once) under ``name, cid``; edges with an end in no group don't count."""
    a = groups.select(F.col("name").alias("src"), F.col("cid").alias("ca"))
    b = groups.select(F.col("name").alias("dst"), F.col("cid").alias("cb"))
    e = edges.join(a, "src").join(b, "dst").select("ca", "cb")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("cid"), F.when(F.col("ca") == F.col("cb"), 0.5).otherwise(0.0).alias("inner"))
    per = ends.groupBy("cid").agg(F.count(F.lit(1)).alias("d"), F.sum("inner").alias("l"))
    return per.agg(F.sum("d").alias("m2"), F.sum("l").alias("l"), F.sum(F.col("d").cast("double") * F.col("d")).alias("dd")).select((F.col("l") / (F.col("m2") / 2) - F.col("dd") / (F.col("m2").cast("double") * F.col("m2"))).alias("modularity"))


def sub_communities(edges: DataFrame, groups: DataFrame, top: int = 15, least_size: int = 100, least_lcc: int = 10, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``name, top, sub``: communities inside the ``top`` largest groups of at least ``least_size`` members.

    Inside a group, members outside the largest component of its subgraph get -1; if that has fewer than ``least_lcc`` nodes,
    all members get 0. Groups run in parallel; one whose subgraph exceeds ``local_edges`` is coarsened first.
    """
    big = groups.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_size).orderBy(F.desc("n"), "cid").limit(top)
    members = written(groups.join(F.broadcast(big.select("cid")), "cid", "left_semi"))  # top rows
    flags = written(component_flags(edges, members, least_lcc))
    core = flags.where("in_lcc and splittable").select("cid", "name")
    inner = written(induced(undirected_edges(edges), core).select(F.col("cid").alias("part"), "src", "dst", F.lit(1.0).alias("weight")))
    over = [r[0] for r in inner.groupBy("part").count().where(F.col("count") > local_edges).select("part").collect()]  # top rows at most
    found = inner.where(~F.col("part").isin(over)).groupBy("part").applyInPandas(lambda pdf: _local(pdf), "part int, name string, community bigint")
    for cid in over:
        found = found.unionByName(communities(inner.where(F.col("part") == cid), local_edges, whole=True).select(F.lit(cid).alias("part"), "name", F.col("cid").cast("long").alias("community")))
    sizes = found.groupBy("part", "community").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"))
    rank = sizes.withColumn("sub", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "least")) - 1)
    placed = found.join(rank.select("part", "community", "sub"), ["part", "community"]).select("name", F.col("part").alias("cid"), "sub")
    made = flags.join(placed, ["cid", "name"], "left")
    return made.select("name", F.col("cid").alias("top"), F.when(~F.col("splittable"), 0).otherwise(F.coalesce("sub", F.lit(-1))).cast("int").alias("sub"))
