"""Bridges between clusters: shared n-grams, theorems with premises from several pure clusters, in-degree filter, elbow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_generic


def gram_bridges(profiles: DataFrame, min_clusters: int = 2, min_count: int = 1, top_k: int | None = 300, filter_generic: bool = True) -> DataFrame:
    """``n, gram, n_clusters, h_norm, rarity, bridge_score, mean_relative_freq, cluster_counts`` of ``n, gram, cid, cnt``.

    Per n: K is the number of clusters with any n-gram and totals are taken before ``min_count``. Totals are small (n x
    clusters) and join back; no window over the profiles. Scores are unrounded. ``top_k`` best per n, ties by n-gram.
    """
    totals = profiles.groupBy("n", "cid").agg(F.sum("cnt").alias("total"))
    ks = totals.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    kept = profiles.where(F.col("cnt") >= min_count).join(totals, ["n", "cid"])
    sums = kept.groupBy("n", "gram").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.log2(F.col("cnt").cast("double"))).alias("clog"), F.avg(F.col("cnt") / F.col("total")).alias("mean_relative_freq"),
        F.array_sort(F.collect_list(F.struct("cid", "cnt"))).alias("cluster_counts"),
    ).where(F.col("n_clusters") >= min_clusters)
    if filter_generic:
        sums = sums.where(~all_generic("gram"))
    # H = log2(s) - sum(c log2 c) / s, so the entropy needs no second pass over the counts
    h = F.log2(F.col("s").cast("double")) - F.col("clog") / F.col("s")
    made = sums.join(F.broadcast(ks), "n")  # one row per n
    made = made.withColumn("h_norm", F.when(F.col("k") > 1, F.abs(h) / F.log2(F.col("k").cast("double"))).otherwise(0.0)).withColumn("rarity", 1 - F.col("mean_relative_freq"))
    made = made.withColumn("bridge_score", F.col("h_norm") * F.col("rarity")).select("n", "gram", "n_clusters", "h_norm", "rarity", "bridge_score", "mean_relative_freq", "cluster_counts")
    if top_k is None:
        return made
    best = Window.partitionBy("n").orderBy(F.round("bridge_score", 9).desc(), F.array_join("gram", "\x00"))
    return made.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top_k).drop("_r")


def premise_links(edges: DataFrame, clusters: DataFrame, pure_cids: DataFrame) -> DataFrame:
    """``src, dst, cid_s, cid_p``: edges from a clustered theorem to a premise in a pure cluster."""
    own = clusters.select(F.col("name").alias("src"), F.col("cid").alias("cid_s"))
    theirs = clusters.join(pure_cids, "cid", "left_semi").select(F.col("name").alias("dst"), F.col("cid").alias("cid_p"))
    return edges.join(theirs, "dst").join(own, "src").select("src", "dst", "cid_s", "cid_p")


def bridge_theorems(edges: DataFrame, clusters: DataFrame, labelled: DataFrame, pure_cids: DataFrame, min_pure: int = 2, top_k: int | None = 500) -> DataFrame:
    """Theorems whose premises lie in at least ``min_pure`` pure clusters, the theorem's own one included.

    ``n_premises`` counts all premises. Cluster ids are distinct and sorted; the labels go with them, sorted, not merged.
    """
    hit = premise_links(edges, clusters, pure_cids).groupBy("src", "cid_s", "cid_p").agg(F.lit(1).alias("one")).drop("one")
    names = labelled.select("cid", "label")
    named = hit.join(names.withColumnRenamed("cid", "cid_p"), "cid_p", "left").withColumn("label", F.coalesce("label", F.col("cid_p").cast("string")))
    per = named.groupBy("src", "cid_s").agg(F.array_sort(F.collect_list("cid_p")).alias("premise_cluster_ids"), F.array_sort(F.collect_list("label")).alias("premise_cluster_labels")).where(F.size("premise_cluster_ids") >= min_pure)
    uses = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_premises"))
    made = per.join(uses, "src").join(names.select(F.col("cid").alias("cid_s"), F.col("label").alias("self_label")), "cid_s", "left")
    made = made.select(F.col("src").alias("theorem"), F.col("cid_s").alias("self_cluster"), F.coalesce("self_label", F.col("cid_s").cast("string")).alias("self_label"), F.size("premise_cluster_ids").cast("long").alias("n_premise_clusters"), "premise_cluster_ids", "premise_cluster_labels", "n_premises")
    return made if top_k is None else made.orderBy(F.desc("n_premise_clusters"), "theorem").limit(top_k)


def pair_counts(found: DataFrame, top_k: int = 15) -> DataFrame:
    """``cid_a, cid_b, n``: how many bridge theorems have premises in both clusters."""
    ids = found.select("theorem", F.explode("premise_cluster_ids").alias("cid"))
    return ids.alias("x").join(ids.alias("y"), "theorem").where("x.cid < y.cid").groupBy(F.col("x.cid").alias("cid_a"), F.col("y.cid").alias("cid_b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cid_a", "cid_b").limit(top_k)


def depth_candidates(edges: DataFrame, clusters: DataFrame, pure_cids: DataFrame, degrees: DataFrame) -> DataFrame:
    """``theorem, n_clusters, min_cross_indegree, cross_premises``: theorems with premises in at least two pure clusters other
    than their own."""
    cross = premise_links(edges, clusters, pure_cids).where("cid_p <> cid_s").join(degrees.select(F.col("name").alias("dst"), "in_degree"), "dst", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    made = cross.groupBy(F.col("src").alias("theorem")).agg(
        F.size(F.collect_set("cid_p")).cast("long").alias("n_clusters"), F.min("in_degree").alias("min_cross_indegree"),
        F.array_sort(F.collect_list(F.struct(F.col("dst").alias("premise"), F.col("cid_p").alias("cid"), "in_degree"))).alias("cross_premises"),
    )
    return made.where("n_clusters >= 2")


def indegree_p90(degrees: DataFrame) -> DataFrame:
    return degrees.agg(F.floor(F.percentile("in_degree", 0.9)).alias("p90"))


def indegree_histogram(degrees: DataFrame) -> DataFrame:
    return degrees.where("in_degree > 0").groupBy("in_degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def indegree_sweep(candidates: DataFrame, degrees: DataFrame) -> DataFrame:
    """``theta, count``: candidates with a cross premise of in-degree <= theta, for theta up to the 90th percentile of all
    nodes' in-degrees in at most about 100 steps."""
    most = F.col("p90")
    thetas = indegree_p90(degrees).where(most.isNotNull()).select(F.explode(F.sequence(F.lit(0).cast("long"), most, F.greatest(F.lit(1).cast("long"), F.floor(most / 100)))).alias("theta"))
    hist = candidates.groupBy("min_cross_indegree").agg(F.count(F.lit(1)).alias("n"))
    both = thetas.select("theta", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")).unionByName(hist.select(F.col("min_cross_indegree").alias("theta"), "n", F.lit(0).alias("asked")))
    upto = Window.orderBy("theta").rangeBetween(Window.unboundedPreceding, 0)  # a few hundred rows
    return both.withColumn("count", F.sum("n").over(upto)).where("asked = 1").select("theta", "count")


def elbow(swept: DataFrame) -> DataFrame:
    """``theta``: the point of the normalised curve furthest from its chord; the last one of fewer than 3, 0 of none."""
    w = Window.orderBy("theta")  # the sweep's few rows
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scale = lambda c: (F.col(c) - F.min(c).over(every)) / (F.max(c).over(every) - F.min(c).over(every) + 1e-9)
    p = swept.select("theta", scale("theta").alias("x"), scale("count").alias("y"))
    ends = [F.first("x").over(every).alias("x1"), F.first("y").over(every).alias("y1"), F.last("x").over(every).alias("x2"), F.last("y").over(every).alias("y2"), F.count(F.lit(1)).over(every).alias("n")]
    d = p.select("theta", "x", "y", *ends).select("theta", "n", F.round(F.abs((F.col("x2") - F.col("x1")) * (F.col("y1") - F.col("y")) - (F.col("y2") - F.col("y1")) * (F.col("x1") - F.col("x"))) / (F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2) + 1e-9), 12).alias("d"))
    chosen = F.when(F.max("n") >= 3, F.max(F.struct("d", (-F.col("theta")).alias("t")))["t"] * -1).otherwise(F.max("theta"))
    return d.agg(F.coalesce(chosen, F.lit(0).cast("long")).alias("theta"))


def filtered(candidates: DataFrame, theta: int) -> DataFrame:
    """Candidates with a cross premise of in-degree <= theta."""
    return candidates.where(F.col("min_cross_indegree") <= theta)
