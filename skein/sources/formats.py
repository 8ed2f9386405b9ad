"""Reading raw collections and JSON lines, writing results as Parquet, JSON and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import anchors, without_anchors


def with_order(df: DataFrame) -> DataFrame:
    """``df`` as read from files, with ``ord``: file, block and row, which compare in the order of the files' lines."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ord"))


def corpus_rows(raw: DataFrame) -> DataFrame:
    """One row per declaration of ``path, premises``; a file without declarations gives none, a missing kind is empty."""
    each = raw.select(F.col("path").alias("file_path"), F.explode("premises").alias("p"))
    return each.select(F.col("p.full_name").alias("full_name"), F.coalesce("p.kind", F.lit("")).alias("kind"), "file_path")


def step_rows(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits put together: premises taken from the anchors of a tactic, the tactic without them, missing fields empty."""

    def one(split: str, raw: DataFrame) -> DataFrame:
        have = set(raw.columns)
        field = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
        kept = ["ord"] if "ord" in have else []
        return raw.select(*kept, field("full_name").alias("full_name"), field("file_path").alias("file_path"), without_anchors(field("tactic")).alias("tactic"), anchors(field("tactic")).alias("premises"), F.lit(split).alias("split"))

    return reduce(lambda a, b: a.unionByName(b), [one(s, r) for s, r in splits.items()])


def numbered(ordered: DataFrame, first: int = 0) -> DataFrame:
    """``ordered`` with ``ord`` as one number that rises with it: the place of the file's block among all, and the row's place
    there. ``first`` numbers a collection that comes after others."""
    blocks = ordered.select("ord.file", "ord.block").distinct()  # a row for each task that reads
    rank = blocks.select(F.struct("file", "block").alias("_b"), F.row_number().over(Window.orderBy("file", "block")).alias("_n"))
    made = ordered.withColumn("_b", F.struct("ord.file", "ord.block")).join(F.broadcast(rank), "_b")
    row = F.col("ord.row").bitwiseAND((1 << 33) - 1)
    return made.withColumn("ord", F.lit(first << 56) + F.shiftleft(F.col("_n").cast("long"), 33) + row).drop("_b", "_n")


def ingest(spark: SparkSession, corpus: str | list[str], steps: dict[str, str | list[str]], folder: str) -> None:
    """Raw JSON lines to the tables ``corpus`` and ``tactic_steps`` of ``folder``, which queries and the pipeline read.

    ``corpus`` has files with their declarations, ``steps`` the tactics of each split by its name; splits are put together in
    the order given. The order of a table is that of splits, files and lines: a later declaration of a name holds, and a
    proof's steps stand as they came (``step_no`` is null, ``step_id`` decides). Missing fields and files without rows give none.
    """
    declared = numbered(with_order(read_json(spark, corpus, schemas.RAW_CORPUS)))
    each = declared.select("ord", F.col("path").alias("file_path"), F.posexplode("premises").alias("pos", "p"))
    rows = each.select(F.struct("ord", "pos").alias("ord"), F.col("p.full_name").alias("full_name"), F.coalesce("p.kind", F.lit("")).alias("kind"), "file_path")
    rows.write.mode("overwrite").parquet(f"{folder}/corpus.parquet")
    raw = {name: numbered(with_order(read_json(spark, path, schemas.RAW_STEPS)), i) for i, (name, path) in enumerate(steps.items())}
    made = step_rows(raw).select("ord", F.col("ord").alias("step_id"), "full_name", "file_path", F.lit(None).cast("int").alias("step_no"), "tactic", "premises", "split")
    made.write.mode("overwrite").parquet(f"{folder}/tactic_steps.parquet")


def read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines with a given schema, so no pass over the data to infer one."""
    return spark.read.schema(schema).json(path)


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return with_order(read_json(spark, path, schemas.CORPUS))


def read_steps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return with_order(read_json(spark, path, schemas.STEPS))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or a frame of that schema without rows where the path is missing."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of the paths that is there."""
    return read_or_empty(spark, next((p for p in paths if exists(spark, p)), paths[-1]), schema)


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_json(df: DataFrame, path: str, order: list[Column] | None = None, first: int | None = None) -> None:
    """JSON lines; ``first`` rows in ``order`` make one file of a report."""
    if order is not None and first is not None:
        df = df.orderBy(*order).limit(first).coalesce(1)
    df.write.mode("overwrite").json(path)


def write_map(df: DataFrame, key: str, path: str) -> None:
    """One JSON object from a small frame: keys as strings, the other columns as the value (a plain value if there is one).

    Only for frames of bounded size, such as labels: the whole object is one row.
    """
    rest = [c for c in df.columns if c != key]
    value = F.col(rest[0]) if len(rest) == 1 else F.struct(*rest)
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), value.alias("value"))))
    df.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Text of ``rank, line``, one file."""
    lines.orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(path)
