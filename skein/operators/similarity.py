"""Token-level edit distance between proofs of different clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT, LEAST_STEPS, CLUSTERS, PER_CLUSTER, BASELINE = 80, 5, 30, 30, 10
#: First code point given to a token, and the range of surrogates that has to be left out.
_FIRST, _HOLE, _HOLE_SIZE = 0x4E00, 0xD800, 0x800


def top_clusters(proofs: DataFrame, k: int = CLUSTERS) -> DataFrame:
    """``cid, n_proofs, cluster_rank`` of the clusters with most proofs, ties by id."""
    best = proofs.groupBy("cid").agg(F.count(F.lit(1)).alias("n_proofs")).orderBy(F.desc("n_proofs"), "cid").limit(k)
    return best.withColumn("cluster_rank", F.row_number().over(Window.orderBy(F.desc("n_proofs"), "cid")))  # k rows


def top_proofs(proofs: DataFrame, chosen: DataFrame, k: int = PER_CLUSTER) -> DataFrame:
    """The ``k`` longest proofs of the chosen clusters, with ``rn``; ties by name."""
    w = Window.partitionBy("cid").orderBy(F.desc("len"), "name")
    kept = proofs.join(F.broadcast(chosen.select("cid", "cluster_rank")), "cid").withColumn("len", F.size("items"))
    return kept.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def coded(chosen: DataFrame) -> DataFrame:
    """``chosen`` with ``code``: its first ``CUT`` items as one character each, so the built-in edit distance works on items."""
    items = chosen.select(F.explode(F.slice("items", 1, CUT)).alias("item")).distinct()
    number = items.withColumn("c", F.row_number().over(Window.orderBy("item")) + F.lit(_FIRST - 1))  # CUT items each of at most k x k proofs
    number = number.select("item", F.when(F.col("c") >= _HOLE, F.col("c") + _HOLE_SIZE).otherwise(F.col("c")).alias("c"))
    placed = chosen.select("cid", "rn", F.posexplode(F.slice("items", 1, CUT)).alias("pos", "item")).join(number, "item")
    text = F.decode(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: F.lpad(F.hex(x["c"]), 8, "0")), "")), "UTF-32")
    codes = placed.groupBy("cid", "rn").agg(text.alias("code"))
    return chosen.join(codes, ["cid", "rn"])


def distance(a: Column, b: Column, la: Column, lb: Column) -> Column:
    """Edit distance of the cut codes over the longer uncut length."""
    return F.levenshtein(a, b) / F.greatest(la, lb, F.lit(1))


def baseline(c: DataFrame, first: int = BASELINE) -> DataFrame:
    """``baseline``: the median distance within clusters, over each one's first proofs; a single proof gives 1."""
    x = c.where(F.col("rn") <= first)
    inside = x.alias("x").join(x.alias("y"), "cid").where("x.rn < y.rn").select(distance(F.col("x.code"), F.col("y.code"), F.col("x.len"), F.col("y.len")).alias("d"))
    single = c.groupBy("cid").agg(F.max("rn").alias("n")).where("n = 1").select(F.lit(1.0).alias("d"))
    return inside.unionByName(single).agg(F.percentile("d", 0.5).alias("baseline"))


def edit_bridges(c: DataFrame, labelled: DataFrame, top_k: int | None = 200) -> DataFrame:
    """The closest pair of proofs of each pair of clusters, where it is closer than the baseline.

    At most ``CLUSTERS * PER_CLUSTER`` proofs, so the pairs of clusters are an inequality join of bounded sides.
    """
    usual = baseline(c).first()[0]  # null without proofs: then nothing is closer
    pairs = c.alias("x").join(c.alias("y"), F.col("x.cluster_rank") < F.col("y.cluster_rank"))
    d = pairs.select(
        F.col("x.cid").alias("cluster_a"), F.col("y.cid").alias("cluster_b"), F.col("x.name").alias("theorem_a"), F.col("y.name").alias("theorem_b"), F.col("x.rn").alias("ra"), F.col("y.rn").alias("rb"),
        F.col("x.items").alias("seq_a"), F.col("y.items").alias("seq_b"), distance(F.col("x.code"), F.col("y.code"), F.col("x.len"), F.col("y.len")).alias("norm_edit_dist"),
    ).where("norm_edit_dist < 1.0")
    w = Window.partitionBy("cluster_a", "cluster_b").orderBy("norm_edit_dist", "ra", "rb")
    best = d.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("baseline", F.lit(usual).cast("double")).where("norm_edit_dist < baseline")
    names = labelled.select("cid", "label")
    best = best.join(names.select(F.col("cid").alias("cluster_a"), F.col("label").alias("la")), "cluster_a", "left").join(names.select(F.col("cid").alias("cluster_b"), F.col("label").alias("lb")), "cluster_b", "left")
    made = best.select("cluster_a", "cluster_b", F.coalesce("la", F.col("cluster_a").cast("string")).alias("label_a"), F.coalesce("lb", F.col("cluster_b").cast("string")).alias("label_b"), "theorem_a", "theorem_b", "norm_edit_dist", (F.col("baseline") - F.col("norm_edit_dist")).alias("surprise"), "seq_a", "seq_b")
    return made if top_k is None else made.orderBy("norm_edit_dist", "cluster_a", "cluster_b").limit(top_k)
