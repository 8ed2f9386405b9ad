"""References to records that don't exist at the time of the reference.

Skew-aware split: references are counted per key and period, the most referenced keys are checked against a broadcast of
their lifetimes, all other keys by a shuffled anti join, and both results are united. Counts of a period in which a key
lives throughout, or never, are settled as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_name
from ..sources.shared import written

#: The keys that get the broadcast check, and the lifetimes that may be broadcast for them or held by one key of the anti join.
HEAVY_KEYS, BROADCAST_ROWS, KEY_ROWS = 1000, 100_000, 1000


def lifetimes(corpus: DataFrame) -> DataFrame:
    """``name, since, until``: of rows with one name and one added_at that with the greatest ord. ``until`` null: still there.

    Rows without a name or an added_at declare nothing. Null ords lose to others; equal ords fall to the later removal.
    """
    rows = corpus.select(clean_name("full_name").alias("name"), F.col("added_at").alias("since"), "ord", "removed_at").where("name is not null and since is not null")
    won = rows.groupBy("name", "since").agg(F.max(F.struct("ord", F.col("removed_at").isNull().alias("open"), "removed_at")).alias("w"))
    return won.select("name", "since", F.col("w.removed_at").alias("until"))


def reference_counts(refs: DataFrame) -> DataFrame:
    """``src_table, month_key, premise, n``: the referring rows of each key and period, counted once however often
    delivered; a null row_id is one more."""
    return refs.groupBy("src_table", "month_key", "premise").agg((F.count_distinct("row_id") + F.max(F.col("row_id").isNull().cast("long"))).alias("n"))


def _dead(refs: DataFrame, lives: DataFrame) -> DataFrame:
    alive = (F.col("premise") == F.col("name")) & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at")))
    return refs.join(lives, alive, "left_anti")


def _dead_asof(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The same for keys with very many lifetimes, without comparing each with each: at any time, a key lives if the latest
    end among the lifetimes begun by then is later. Both sides are cut together into ranges of (key, time, row), so a key
    that is hot within one month, or at one time, is spread; the maximum runs inside a range and is carried over from the
    ranges before, of which a key has as many as there are tasks."""
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    kept = [c for c in refs.columns if c not in ("premise", "at")]
    a = lives.select(F.col("name").alias("key"), F.col("since").cast("timestamp_ntz").alias("t"), F.lit(0).alias("kind"), F.coalesce(F.col("until").cast("timestamp_ntz"), forever).alias("end"), *[F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in kept], F.lit(None).cast(refs.schema["at"].dataType).alias("at"))
    b = refs.select(F.col("premise").alias("key"), F.col("at").cast("timestamp_ntz").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("end"), *kept, "at")
    both = written(a.unionByName(b).repartitionByRange("key", "t", "kind", "row_id").withColumn("range", F.spark_partition_id()))
    past = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy("key", "range").agg(F.max("end").alias("end")).select("key", "range", F.max("end").over(past).alias("before"))
    here = Window.partitionBy("key", "range").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.withColumn("here", F.max("end").over(here)).where("kind = 1").join(carry, ["key", "range"]).withColumn("latest", F.greatest("here", "before"))
    return ends.where("t is null or latest is null or latest <= t").select(F.col("key").alias("premise"), "at", *kept).select(refs.columns)


def _prepared(refs: DataFrame, lives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides written once; a reference with its month."""
    refs = refs.select("src_table", "row_id", "premise", "at", F.date_format("at", "yyyy-MM").alias("month_key")).where("premise is not null")
    return written(refs), written(lives.select("name", "since", "until"))


def _orphans(refs: DataFrame, lives: DataFrame, counts: DataFrame, heavy_keys: int, broadcast_rows: int, key_rows: int) -> DataFrame:
    found, rest = refs.limit(0), refs
    many = lives.groupBy("name").count().where(F.col("count") > key_rows).select("name")
    n_many = many.limit(broadcast_rows + 1).count()
    if n_many:
        many = F.broadcast(many) if n_many <= broadcast_rows else many
        found = _dead_asof(rest.join(many, rest.premise == many.name, "left_semi"), lives.join(many, "name", "left_semi"))
        rest, lives = rest.join(many, rest.premise == many.name, "left_anti"), lives.join(many, "name", "left_anti")
    per_key = counts.groupBy("premise").agg(F.sum("n").alias("n"))
    heavy = [r[0] for r in per_key.orderBy(F.desc("n"), "premise").limit(heavy_keys).collect()]  # heavy_keys rows at most
    is_heavy, theirs = F.col("premise").isin(heavy), lives.where(F.col("name").isin(heavy))
    if theirs.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = found.unionByName(_dead(rest.where(is_heavy), F.broadcast(theirs)))
    else:  # too many lifetimes for a broadcast: the running maximum for these keys too
        found = found.unionByName(_dead_asof(rest.where(is_heavy), theirs))
    found = found.unionByName(_dead(rest.where(~is_heavy), lives.where(~F.col("name").isin(heavy))))
    return found.select("src_table", "month_key", "row_id", "premise").distinct()


def orphans(refs: DataFrame, lives: DataFrame, heavy_keys: int = HEAVY_KEYS, broadcast_rows: int = BROADCAST_ROWS, key_rows: int = KEY_ROWS) -> DataFrame:
    """``src_table, month_key, row_id, premise`` of the references (``src_table, row_id, premise, at``) to no living key, once each.

    A reference with a null premise is none. With a null time nothing lives, so it is an orphan of month null.
    """
    refs, lives = _prepared(refs, lives)
    return _orphans(refs, lives, reference_counts(refs), heavy_keys, broadcast_rows, key_rows)


def orphan_counts(refs: DataFrame, lives: DataFrame, heavy_keys: int = HEAVY_KEYS, broadcast_rows: int = BROADCAST_ROWS, key_rows: int = KEY_ROWS) -> DataFrame:
    """``src_table, month_key, n_orphans``: how many rows ``orphans`` has of each table and month; none for a month without.

    The counts of a key and month are settled at once where the key lives through the whole month, or not at all in it. Only
    references of the other months are looked at one by one.
    """
    refs, lives = _prepared(refs, lives)
    counts = written(reference_counts(refs))
    months = counts.where("month_key is not null").groupBy("premise", "month_key").agg(F.sum("n").alias("n"))
    start = F.to_timestamp_ntz(F.concat("month_key", F.lit("-01 00:00:00")))
    end = start + F.expr("interval 1 month")
    since, until = F.col("since").cast("timestamp_ntz"), F.col("until").cast("timestamp_ntz")
    through = (since <= start) & (until.isNull() | (until >= end))
    touches = (since < end) & (until.isNull() | (until > start))
    told = months.join(lives, months.premise == lives.name, "left").groupBy("premise", "month_key").agg(
        F.max("n").alias("n"), F.coalesce(F.max(F.when(through, 2).when(touches, 1)), F.lit(0)).alias("state")
    )
    told = written(told)
    never = told.where("state = 0").select("premise", "month_key")
    by_month = ["src_table", "month_key"]
    dead = counts.join(never, ["premise", "month_key"], "left_semi").unionByName(counts.where("month_key is null")).groupBy(*by_month).agg(F.sum("n").alias("n"))
    top = written(told.orderBy(F.desc("n"), "premise", "month_key").limit(heavy_keys))  # heavy_keys rows at most
    keys = ["premise", "month_key"]
    open_ = refs.join(F.broadcast(top.where("state = 1").select(keys)), keys, "left_semi")
    rest = told.where("state = 1").select(keys).join(F.broadcast(top.select(keys)), keys, "left_anti")
    open_ = open_.unionByName(refs.join(F.broadcast(top.select(keys)), keys, "left_anti").join(rest, keys, "left_semi").select(open_.columns)).select(refs.columns)
    some = _orphans(open_, lives, counts.join(told.where("state = 1"), keys, "left_semi"), heavy_keys, broadcast_rows, key_rows).groupBy(*by_month).agg(F.count(F.lit(1)).alias("n"))
    return dead.unionByName(some).groupBy(*by_month).agg(F.sum("n").alias("n_orphans"))
