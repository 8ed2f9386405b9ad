"""Counts over arriving steps and events, with watermarks for late rows. The same functions work on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import leading_word


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total``: events per window and type; rows later than ``late`` are dropped in a stream."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    made = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def word_counts(steps: DataFrame, width: str = "30 days", late: str = "60 days") -> DataFrame:
    """``start, word, n``: leading words of steps by month-long windows of recorded_at, each step once however often it is
    delivered within the watermark."""
    s = steps.select(F.col("recorded_at").cast("timestamp").alias("at"), "step_id", leading_word("tactic").alias("word")).where("word is not null and step_id is not null")
    s = s.withWatermark("at", late).dropDuplicatesWithinWatermark(["step_id"]) if steps.isStreaming else s.dropDuplicates(["step_id"])
    made = s.groupBy(F.window("at", width), "word").agg(F.count(F.lit(1)).alias("n"))
    return made.select(F.col("window.start").alias("start"), "word", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows, appended to Parquet exactly once; runs through what is there and stops."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
