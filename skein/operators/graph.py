"""Directed graphs as a pair of DataFrames: nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Each pair of linked nodes once, as ``src < dst``; loops are dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node of its component) by alternating large and small stars.

    Every round links each node's larger neighbours, or its smaller ones, to the least node it knows. A hub's neighbours are
    never collected: the least is a combinable aggregate and the links are joined back. Every round is written to the shared
    folder, which cuts the lineage, and takes the place of the one before. Stops when a round leaves the edges as they were. ``nodes`` (``name``) adds the
    isolated ones, each its own component.
    """
    links = written(undirected_edges(edges))

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # every neighbour, larger ones are relinked
            both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
            return both.where("dst > src").join(least, "src").select(F.col("m").alias("src"), "dst").where("src <> dst").distinct()
        least = e.groupBy("dst").agg(F.min("src").alias("m"))  # e has src < dst: smaller neighbours of dst
        moved = e.join(least, "dst")
        return moved.select(F.col("m").alias("src"), F.col("src").alias("dst")).unionByName(moved.select(F.col("m").alias("src"), "dst")).where("src <> dst").distinct()

    def sign(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()

    before = sign(links)
    for _ in range(max_rounds):
        links, last = written(star(star(links, True), False)), links
        discard(last)
        now = sign(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected_components: not settled; raise max_rounds")
    found = links.select(F.col("dst").alias("node"), F.col("src").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    if nodes is not None:
        alone = nodes.select(F.col("name").alias("node")).distinct().join(found, "node", "left_anti")
        found = found.unionByName(alone.select("node", F.col("node").alias("component")))
    return found


def node_union(corpus: DataFrame, theorems: DataFrame, premises: DataFrame) -> DataFrame:
    """``name, file_path``: theorem nodes overwrite corpus nodes, which overwrite nodes only known as premises (empty path)."""
    named = corpus.select("name", F.struct(F.lit(1).alias("prio"), F.coalesce("file_path", F.lit("")).alias("file_path")).alias("v"))
    named = named.unionByName(theorems.select("name", F.struct(F.lit(2).alias("prio"), F.coalesce("file_path", F.lit("")).alias("file_path")).alias("v")))
    named = named.unionByName(premises.select("name", F.struct(F.lit(0).alias("prio"), F.lit("").alias("file_path")).alias("v")))
    return named.groupBy("name").agg(F.max("v").alias("v")).select("name", F.col("v.file_path").alias("file_path"))


def edges_of(steps: DataFrame) -> DataFrame:
    """``src, dst`` of ``name, premises``: a proof uses a premise; distinct, without loops."""
    return steps.select(F.col("name").alias("src"), F.explode("premises").alias("dst")).where("src is not null and dst is not null and dst <> '' and dst <> src").distinct()


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``name, in_degree`` of all nodes, zeros kept."""
    n = edges.groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("name").join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("in_degree"))


def induced(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``cid, src, dst`` of the edges with both ends in one group of ``name, cid``: every group's subgraph at once."""
    a = groups.select(F.col("name").alias("src"), F.col("cid").alias("cid"))
    b = groups.select(F.col("name").alias("dst"), F.col("cid").alias("cid_b"))
    return edges.join(a, "src").join(b, "dst").where("cid = cid_b").select("cid", "src", "dst")


def largest_component(components: DataFrame) -> DataFrame:
    """Rows of the largest component; ties fall to the least component id."""
    best = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return components.join(F.broadcast(best.select("component")), "component", "left_semi")  # one row


def component_flags(edges: DataFrame, groups: DataFrame, least: int = 10) -> DataFrame:
    """``cid, name, in_lcc, splittable`` for every member of every group: whether it is in the largest component of its
    group's subgraph, and whether that has at least ``least`` nodes. All groups run in the same rounds."""
    tag = lambda c: F.concat(F.col("cid").cast("string"), F.lit("\x00"), F.col(c))
    inside = induced(edges, groups).select(tag("src").alias("src"), tag("dst").alias("dst"))
    members = groups.select("cid", "name", tag("name").alias("node"))
    found = connected_components(inside, members.select(F.col("node").alias("name")))
    sized = members.join(found, "node")
    per = sized.groupBy("cid", "component").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("b")).select("cid", F.col("b.component").alias("best"), (-F.col("b.n")).alias("lcc_size"))
    return sized.join(best, "cid").select("cid", "name", (F.col("component") == F.col("best")).alias("in_lcc"), (F.col("lcc_size") >= least).alias("splittable"))
