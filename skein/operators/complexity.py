"""Interaction of clusters through bridge theorems: integration, differentiation, complexity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def interaction(candidates: DataFrame, clusters: DataFrame, labelled: DataFrame) -> DataFrame:
    """``i, j, weight``: bridge theorems of cluster i with a cross premise in cluster j, both directions, no zero entries."""
    theirs = candidates.select("theorem", F.explode(F.array_distinct(F.transform("cross_premises", lambda p: p["cid"]))).alias("j"))
    known = labelled.select("cid")
    own = clusters.select(F.col("name").alias("theorem"), F.col("cid").alias("i"))
    links = theirs.join(own, "theorem").where("i <> j").join(known.withColumnRenamed("cid", "i"), "i", "left_semi").join(known.withColumnRenamed("cid", "j"), "j", "left_semi")
    once = links.groupBy("i", "j").agg(F.count(F.lit(1)).alias("w"))
    return once.unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("weight"))


def by_label(recorded: DataFrame, labelled: DataFrame, theta: int | None = None, kept: int = 5) -> DataFrame:
    """Recorded bridges, whose premises name a label, in the shape of candidates: the first cluster with that label stands
    for it, -1 for an unknown one. ``theta`` leaves premises of at most that in-degree, of which ``kept`` are taken.

    A label of several clusters is lossy, which is why the analysis itself uses ids.
    """
    first = labelled.groupBy("label").agg(F.min("cid").alias("cid"))
    p = F.col("cross_cluster_premises")
    if theta is not None:
        p = F.slice(F.filter(p, lambda x: x["in_degree"] <= theta), 1, kept)
    each = recorded.select("theorem", F.explode(p).alias("p")).select("theorem", "p.premise", F.col("p.cluster_label").alias("label"), "p.in_degree")
    found = each.join(first, "label", "left").select("theorem", F.struct("premise", F.coalesce("cid", F.lit(-1)).alias("cid"), "in_degree").alias("p"))
    return found.groupBy("theorem").agg(F.array_sort(F.collect_list("p")).alias("cross_premises"))


def integration(w: DataFrame, labelled: DataFrame) -> DataFrame:
    """``cid, integration, total_bridge_connections``: entropy of each cluster's links; zero for a cluster without any."""
    total = Window.partitionBy("i")
    p = F.col("weight") / F.col("t")
    per = w.withColumn("t", F.sum("weight").over(total)).groupBy(F.col("i").alias("cid")).agg((-F.sum(p * F.log2(p + EPS))).alias("h"), F.sum("weight").alias("n"))
    return labelled.select("cid").join(per, "cid", "left").select("cid", F.coalesce("h", F.lit(0.0)).alias("integration"), F.coalesce("n", F.lit(0)).alias("total_bridge_connections"))


def differentiation(labelled: DataFrame) -> DataFrame:
    """``cid, differentiation``: 1 - entropy of the top modules' shares over log2(their number + 1); 0 without modules."""
    m = labelled.select("cid", F.explode("top_modules").alias("m")).select("cid", F.col("m.cnt").alias("cnt"))
    m = m.withColumn("t", F.sum("cnt").over(Window.partitionBy("cid")))
    p = F.col("cnt") / F.col("t")
    d = m.groupBy("cid").agg((1 + F.sum(p * F.log2(p + EPS)) / F.log2(F.count(F.lit(1)) + F.lit(1.0))).alias("d"))
    return labelled.select("cid").join(d, "cid", "left").select("cid", F.coalesce("d", F.lit(0.0)).alias("differentiation"))


def complexity(w: DataFrame, labelled: DataFrame) -> DataFrame:
    both = integration(w, labelled).join(differentiation(labelled), "cid").join(labelled.select("cid", "label", "size", "is_mixed"), "cid")
    return both.select("cid", "label", "size", "integration", "differentiation", (F.col("integration") * F.col("differentiation")).alias("neural_complexity"), "total_bridge_connections", "is_mixed")


def global_complexity(w: DataFrame, labelled: DataFrame) -> DataFrame:
    """``global_cn``: mean difference of integration over linked pairs, by weight; 0 without links."""
    h = integration(w, labelled)
    pairs = w.where("i < j").join(h.select(F.col("cid").alias("i"), F.col("integration").alias("hi")), "i").join(h.select(F.col("cid").alias("j"), F.col("integration").alias("hj")), "j")
    return pairs.agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.abs(F.col("hi") - F.col("hj"))), F.sum("weight")), F.lit(0.0)).alias("global_cn"))
