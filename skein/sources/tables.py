"""Parquet tables of a folder, and the one-delivery view of redelivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_delivery(df: DataFrame, key: str, keep: dict[str, Column], order: str = "ord") -> DataFrame:
    """One row per ``key``: the columns ``keep`` of its delivery with the least ``order`` (null orders last).

    Rows with a null key are left out. Equal orders fall to the least values. The winner is found with a
    combinable aggregate, so a key delivered very often is reduced before the shuffle.
    """
    packed = F.struct(F.col(order).isNull().alias("_no"), F.col(order).alias("_at"), *[c.alias(n) for n, c in keep.items()])
    won = df.where(F.col(key).isNotNull()).select(key, packed.alias("_row")).groupBy(key).agg(F.min("_row").alias("_row"))
    return won.select(key, *[F.col(f"_row.{n}").alias(n) for n in keep])


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """The tables as temporary views, to be queried with ``spark.sql``."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
