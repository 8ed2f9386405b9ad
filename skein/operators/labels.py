"""Labels of groups by the categories of their members: mode, share, entropy, mixed or pure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIXED_BELOW, PURE_FROM, TOP = 0.40, 0.50, 5


def distribution(members: DataFrame, keys: list[str], category: str = "module") -> DataFrame:
    """``keys, category, cnt``."""
    return members.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("cnt"))


def ranked(counts: DataFrame, keys: list[str], category: str = "module") -> DataFrame:
    """``counts`` with ``rank`` (most first, ties by category) and the group's ``total``."""
    w = Window.partitionBy(*keys)
    return counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("cnt"), category))).withColumn("total", F.sum("cnt").over(w))


def entropy_of(cnt: Column, total: Column) -> Column:
    """Shannon entropy in bits of a group, as an aggregate; 0 for one category."""
    p = cnt / total
    return F.abs(-F.sum(p * F.log2(p)))


def top_modules(counts: DataFrame, keys: list[str], k: int = TOP) -> DataFrame:
    """``keys, top_modules``: the ``k`` most frequent categories with their counts, most first."""
    best = ranked(counts, keys).where(F.col("rank") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "module", "cnt"))), lambda x: F.struct(x["module"].alias("module"), x["cnt"].alias("cnt")))
    return best.groupBy(*keys).agg(listed.alias("top_modules"))


def labels(counts: DataFrame, keys: list[str], mixed_below: float = MIXED_BELOW, top: int = TOP, named: int = 3) -> DataFrame:
    """One row a group: ``label, dominant_module, dominant_fraction, entropy, norm_entropy, is_mixed, size, top_modules``.

    Mixed: the largest category's share, unrounded, is below ``mixed_below``; its label names the three largest. The
    shares are left unrounded; round them for presentation. Categories are few, so a group's counts fit one task.
    """
    r = ranked(counts, keys)
    k = F.count(F.lit(1))
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "module", "cnt"))))
    made = r.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col("module"))).alias("dominant_module"),
        (F.max("cnt") / F.max("total")).alias("dominant_fraction"),
        entropy_of(F.col("cnt"), F.col("total")).alias("entropy"),
        k.alias("n_modules"),
        F.max("total").alias("size"),
        listed.alias("t"),
    )
    made = made.withColumn("is_mixed", F.col("dominant_fraction") < mixed_below)
    made = made.withColumn("norm_entropy", F.when(F.col("n_modules") > 1, F.col("entropy") / F.log2(F.col("n_modules").cast("double"))).otherwise(F.col("entropy")))
    names = F.array_join(F.transform(F.slice("t", 1, named), lambda x: x["module"]), " + ")
    return made.select(
        *keys, F.when(F.col("is_mixed"), names).otherwise(F.col("dominant_module")).alias("label"), "dominant_module", "dominant_fraction", "entropy", "norm_entropy", "is_mixed", "size",
        F.transform("t", lambda x: F.struct(x["module"].alias("module"), x["cnt"].alias("cnt"))).alias("top_modules"),
    )


def pure(labelled: DataFrame, pure_from: float = PURE_FROM) -> DataFrame:
    """Groups that aren't mixed and whose largest share, rounded to 3 places, reaches ``pure_from``."""
    return labelled.where(~F.col("is_mixed") & (F.round("dominant_fraction", 3) >= pure_from))


def mixed_pure_counts(labelled: DataFrame, pure_from: float = PURE_FROM) -> DataFrame:
    return labelled.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if("is_mixed").alias("n_mixed"), F.count_if(~F.col("is_mixed") & (F.round("dominant_fraction", 3) >= pure_from)).alias("n_pure"))
