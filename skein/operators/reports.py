"""Text reports: numbered lines of fixed width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shortened(c: Column | str, width: int = 57) -> Column:
    """At most ``width`` characters, the last three of a longer text as dots."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def lines(df: DataFrame, order: list[Column], pattern: str, *values: Column, top: int = 40) -> DataFrame:
    """``rank, line`` of the first ``top`` rows in order; ``pattern`` formats the rank and the values."""
    first = df.orderBy(*order).limit(top)
    rank = F.row_number().over(Window.orderBy(*order))  # top rows
    return first.select(rank.alias("rank"), *[v.alias(f"_{i}") for i, v in enumerate(values)]).select("rank", F.format_string(pattern, "rank", *[f"_{i}" for i in range(len(values))]).alias("line"))


def joined_labels(c: str, sep: str = " · ") -> Column:
    """Distinct labels of a list, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(c)), sep)


def of_labels(labelled: DataFrame) -> DataFrame:
    return lines(labelled, [F.desc("size"), F.col("cid")], "%3d  C%-4d %6d  %.3f  %.3f  %s", F.col("cid"), F.col("size"), F.col("dominant_fraction"), F.col("norm_entropy"), shortened("label"))


def of_bridges(found: DataFrame) -> DataFrame:
    return lines(found, [F.desc("bridge_score"), F.array_join("gram", "\x00")], "%3d  %-57s  %3d  %.4f  %.6f  %.6f", shortened(F.array_join("gram", " → ")), F.col("n_clusters"), F.col("h_norm"), F.col("rarity"), F.col("bridge_score"), top=30)


def of_theorems(found: DataFrame, top: int = 200) -> DataFrame:
    return lines(found, [F.desc("n_premise_clusters"), F.col("theorem")], "%3d  %-57s  %2d  [%s]  %s", shortened("theorem"), F.col("n_premise_clusters"), F.col("self_label"), joined_labels("premise_cluster_labels"), top=top)


def of_edit_bridges(found: DataFrame, top: int = 100) -> DataFrame:
    first = F.concat_ws(" → ", F.slice("seq_a", 1, 10))
    return lines(found, [F.col("norm_edit_dist"), F.col("cluster_a"), F.col("cluster_b")], "%3d  %.3f  %s ↔ %s  %s | %s  %s", F.col("norm_edit_dist"), F.col("label_a"), F.col("label_b"), shortened("theorem_a"), shortened("theorem_b"), first, top=top)


def of_candidates(found: DataFrame, labelled: DataFrame, theta: int | None = None, top: int = 200) -> DataFrame:
    """Filtered bridges with the labels reached, merged and sorted, and their premises (of in-degree up to ``theta``) by in-degree."""
    first = found.orderBy(F.desc("n_clusters"), "min_cross_indegree", "theorem").limit(top)
    named = first.select("theorem", "n_clusters", "min_cross_indegree", F.explode("cross_premises").alias("p")).join(labelled.select(F.col("cid").alias("c"), "label"), F.col("p.cid") == F.col("c"), "left")
    per = named.groupBy("theorem", "n_clusters", "min_cross_indegree").agg(F.collect_set(F.coalesce("label", F.lit("?"))).alias("labels"), F.array_sort(F.collect_list(F.struct("p.in_degree", "p.premise"))).alias("ps"))
    low = F.col("ps") if theta is None else F.filter("ps", lambda p: p["in_degree"] <= theta)
    premises = F.array_join(F.transform(low, lambda p: F.concat(p["premise"], F.lit("("), p["in_degree"].cast("string"), F.lit(")"))), ", ")
    return lines(per, [F.desc("n_clusters"), F.col("min_cross_indegree"), F.col("theorem")], "%3d  %-57s  %2d  %3d  %s  %s", shortened("theorem"), F.col("n_clusters"), F.col("min_cross_indegree"), joined_labels("labels"), premises, top=top)


def of_complexity(metrics: DataFrame, top: int = 20) -> DataFrame:
    return lines(metrics, [F.desc(F.round("neural_complexity", 9)), F.col("cid")], "%3d  C%-4d %-40s  %.4f  %.4f  %.4f  %d", F.col("cid"), shortened("label", 40), F.col("integration"), F.col("differentiation"), F.col("neural_complexity"), F.col("total_bridge_connections"), top=top)


def of_verdicts(found: DataFrame) -> DataFrame:
    return lines(found, [F.col("bridge")], "%2d  %-40s  %-8s  %-4s  %s", shortened("bridge", 40), F.col("found"), F.col("spans"), F.col("detected"))
