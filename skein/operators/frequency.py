"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are grouped by key *and* value first, which spreads a hot key over every partition, and then by key alone. The
second grouping meets at most one partial row of a key per partition, however many rows the key had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``key, value, weight``: the rows of each pair. Null keys are left out, null values stay a value."""
    return df.select(key.alias("key"), value.alias("value")).where("key is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def key_profile(df: DataFrame, key: Column, values: dict[str, Column], rows: str = "n_rows") -> DataFrame:
    """``key``, the rows of each key as ``rows``, and for each named value the number of its distinct non-null values.

    Exact. Rows with a null key are left out; an empty table gives no rows. Several values share one shuffle: each row
    is sent once per value, with the others null.
    """
    names = list(values)
    kinds = [F.struct(F.lit(i).alias("kind"), *[(values[n] if i == k else F.nullif(values[n], values[n])).alias(f"v{k}") for k, n in enumerate(names)]) for i in range(len(names))]
    sent = df.withColumn("_key", key).where("_key is not null").select(F.col("_key").alias("key"), F.explode(F.array(*kinds)).alias("s")).select("key", "s.*")
    packed = sent.groupBy("key", "kind", *[f"v{k}" for k in range(len(names))]).agg(F.count(F.lit(1)).alias("weight"))
    distinct = [F.count(F.when(F.col("kind") == k, F.col(f"v{k}"))).alias(n) for k, n in enumerate(names)]
    return packed.groupBy("key").agg(F.sum(F.when(F.col("kind") == 0, F.col("weight"))).alias(rows), *distinct)


def modes(weighted: DataFrame) -> DataFrame:
    """``key, mode, weight``: the value with most rows; ties fall to the least value, a null value counts last."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col("value").isNull().alias("no"), "value")).alias("b")
    return weighted.groupBy("key").agg(best).select("key", F.col("b.value").alias("mode"), (-F.col("b.w")).alias("weight"))


def percentiles(weighted: DataFrame, shares: list[float], splits: int = 1000) -> DataFrame:
    """``key, share, value``: the least value that at least ``share`` of a key's rows don't exceed. Null values are left out.

    No key's values are brought into one task: values are cut into at most ``splits`` ranges, the range that holds the
    answer is found from range totals (at most ``splits`` + 1 rows a key), and only that range is ranked.
    """
    w = weighted.where("value is not null")
    cuts = sorted(set(w.select(F.percentile_approx("value", [i / splits for i in range(1, splits)], 10 * splits)).first()[0] or []))
    ranged = w.withColumn("part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("value"))) if cuts else F.lit(0))
    upto = Window.partitionBy("key").orderBy("part")
    parts = ranged.groupBy("key", "part").agg(F.sum("weight").alias("n"))
    parts = parts.select("key", "part", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "n", F.sum("n").over(Window.partitionBy("key")).alias("total"))
    asked = parts.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total"))))
    asked = asked.where("upto >= need and upto - n < need").select("key", "part", "share", (F.col("need") - F.col("upto") + F.col("n")).alias("rest"))
    inside = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(asked.select("key", "part").distinct(), ["key", "part"], "left_semi").withColumn("at", F.sum("weight").over(inside))
    return ranked.join(asked, ["key", "part"]).where("at >= rest and at - weight < rest").select("key", "share", "value")
