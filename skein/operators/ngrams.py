"""Sliding windows over sequences and their spread over clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(items: Column | str, n: Column | int) -> Column:
    """Every run of exactly ``n`` items; none where the sequence is shorter."""
    items = items if isinstance(items, Column) else F.col(items)
    n = F.lit(n) if isinstance(n, int) else n
    runs = F.transform(F.sequence(F.lit(1), F.size(items) - n + 1), lambda i: F.slice(items, i, n))
    return F.when(F.size(items) >= n, runs).otherwise(F.array().cast("array<array<string>>"))


def profiles(proofs: DataFrame, lengths: list[int], least_steps: int = 3) -> DataFrame:
    """``n, gram, cid, cnt`` of ``cid, items``; sequences with fewer than ``least_steps`` items are left out.

    Only the cluster and the items are carried into the explode, and counts are combined before the shuffle.
    """
    kept = proofs.where(F.size("items") >= least_steps).select("cid", "items", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    grams = kept.select("n", "cid", F.explode(windows("items", F.col("n"))).alias("gram"))
    return grams.groupBy("n", "gram", "cid").agg(F.count(F.lit(1)).alias("cnt"))


def sweep(proofs: DataFrame, max_n: int = 8, least_steps: int = 3) -> DataFrame:
    """How far n-grams spread over clusters, for each n up to ``max_n``, in one pass.

    ``proofs`` has ``cid, n_steps, items``: a proof counts if it has ``least_steps`` steps, whatever its number of items.
    """
    kept = proofs.where(F.col("n_steps") >= least_steps).select("cid", "items", F.explode(F.sequence(F.lit(1), F.lit(max_n))).alias("n"))
    spread = kept.select("n", "cid", F.explode(windows("items", F.col("n"))).alias("gram")).distinct().groupBy("n", "gram").agg(F.count(F.lit(1)).alias("k"))
    share = lambda least: F.avg((F.col("k") >= least).cast("double")).alias(f"frac_ge{least}")
    at = F.percentile("k", F.array(F.lit(0.5), F.lit(0.9)))
    made = spread.groupBy("n").agg(F.count(F.lit(1)).alias("total_unique"), share(2), share(3), share(5), at.alias("p"), F.max("k").alias("max_clusters"))
    return made.select("n", "total_unique", "frac_ge2", "frac_ge3", "frac_ge5", F.col("p")[0].alias("median_clusters"), F.col("p")[1].alias("p90_clusters"), "max_clusters")


def best_n(swept: DataFrame, below: float = 0.02, otherwise: int = 3) -> DataFrame:
    """The least n >= 2 whose share of n-grams in two clusters is below ``below``."""
    return swept.agg(F.coalesce(F.min(F.when((F.col("n") >= 2) & (F.col("frac_ge2") < below), F.col("n"))), F.lit(otherwise)).alias("best_n"))
