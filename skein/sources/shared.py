"""The folder that all executors share, for tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only on a local master where it is unset, as in tests, a temporary folder."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a Parquet table just written to the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._skein_path = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the table that ``written`` made for ``df``, when nothing to come reads it."""
    path = df._skein_path
    _written.remove(path)
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables this process has written to the shared folder, once no frame that reads them is needed; their number."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n
