"""Queries on hot keys (p1) and missing records (p2), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_name, sql_name
from ..operators import frequency, orphans
from ..sources.shared import written
from ..sources.tables import table

#: Shares of all elements from which a premise, and of all entries from which an in-degree, is a heavy value.
PREMISE_PERCENT, DEGREE_PERCENT = 1.5, 5.0


def references(spark: SparkSession, d: str) -> DataFrame:
    """``premise, step_id, theorem``: every element of ``tactic_steps.premises`` that is a name."""
    e = table(spark, d, "tactic_steps").select("step_id", "full_name", F.explode("premises").alias("p"))
    return e.select(clean_name("p").alias("premise"), "step_id", clean_name("full_name").alias("theorem")).where("premise is not null")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """``in_degree, premise``: every entry of ``cross_cluster_premises``."""
    e = table(spark, d, "bridge_theorems_filtered").select("theorem", F.explode("cross_cluster_premises").alias("e"))
    return e.select(F.col("e.in_degree").alias("in_degree"), clean_name("e.premise").alias("premise"), clean_name("theorem").alias("theorem"))


def p1_premises(spark: SparkSession, d: str) -> DataFrame:
    made = frequency.key_profile(references(spark, d), F.col("premise"), {"n_steps": F.col("step_id"), "n_theorems": F.col("theorem")}, "n_references")
    return made.withColumnRenamed("key", "premise")


def p1_in_degrees(spark: SparkSession, d: str) -> DataFrame:
    made = frequency.key_profile(entries(spark, d), F.col("in_degree"), {"n_premises": F.col("premise")}, "n_entries")
    return made.withColumnRenamed("key", "in_degree")


def p1_modes(spark: SparkSession, d: str) -> DataFrame:
    """The theorem that refers to each premise most often."""
    made = frequency.modes(frequency.weighted_values(references(spark, d), F.col("premise"), F.col("theorem")))
    return made.select(F.col("key").alias("premise"), F.col("mode").alias("theorem"), F.col("weight").alias("n_references"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 90th percentile of the recorded in-degree over the entries of each premise."""
    made = frequency.percentiles(frequency.weighted_values(entries(spark, d), F.col("premise"), F.col("in_degree")), [0.5, 0.9])
    return made.select(F.col("key").alias("premise"), "share", F.col("value").alias("in_degree"))


def _heavy(weighted: DataFrame, percent: float, field: str) -> DataFrame:
    per = written(weighted.groupBy("key").agg(F.sum("weight").alias("n")))
    total = per.agg(F.sum("n")).first()[0] or 0
    return per.where(F.col("n") * 100.0 >= percent * total).select(F.lit(field).alias("src_field"), F.col("key").cast("string").alias("key_value"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    premises = frequency.weighted_values(references(spark, d), F.col("premise"), F.col("theorem"))
    degrees = frequency.weighted_values(entries(spark, d), F.col("in_degree"), F.col("premise"))
    return _heavy(premises, PREMISE_PERCENT, "premises").unionByName(_heavy(degrees, DEGREE_PERCENT, "in_degree"))


def premise_references(spark: SparkSession, d: str) -> DataFrame:
    """``src_table, row_id, premise, at`` of both referring tables."""
    a = table(spark, d, "tactic_steps").select(F.lit("tactic_steps").alias("src_table"), F.col("step_id").alias("row_id"), F.explode("premises").alias("p"), F.col("recorded_at").alias("at"))
    b = table(spark, d, "bridge_theorems_filtered").select(F.lit("bridge_theorems_filtered").alias("src_table"), F.col("bridge_id").alias("row_id"), F.explode("cross_cluster_premises.premise").alias("p"), F.col("recorded_at").alias("at"))
    return a.unionByName(b).select("src_table", "row_id", clean_name("p").alias("premise"), "at")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(premise_references(spark, d), orphans.lifetimes(table(spark, d, "corpus"))).select("src_table", "month_key", "row_id", "premise")


def p2_months(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    return orphans.orphan_counts(premise_references(spark, d), orphans.lifetimes(table(spark, d, "corpus")))


QUERIES = {f.__name__: f for f in (p1_premises, p1_in_degrees, p1_modes, p1_percentiles, p1_found, p2_found, p2_months)}

_REFS = f"refs as (select {sql_name('p')} premise, step_id, {sql_name('full_name')} theorem from (select step_id, full_name, unnest(premises) p from tactic_steps))"
_ENTRIES = f"entries as (select e.in_degree in_degree, {sql_name('e.premise')} premise from (select unnest(cross_cluster_premises) e from bridge_theorems_filtered))"
_P2 = f"""lives as (
  select name, added_at since, arg_max(coalesce(removed_at, timestamp '9999-01-01'), ord) until
  from (select {sql_name('full_name')} name, added_at, removed_at, ord from corpus) where name is not null and added_at is not null group by 1, 2),
refs as (
  select distinct src_table, month_key, row_id, {sql_name('p')} premise, seen from (
    select 'tactic_steps' src_table, strftime(recorded_at, '%Y-%m') month_key, step_id row_id, unnest(premises) p, recorded_at seen from tactic_steps
    union all
    select 'bridge_theorems_filtered', strftime(recorded_at, '%Y-%m'), bridge_id, unnest(cross_cluster_premises).premise, recorded_at from bridge_theorems_filtered)),
found as (
  select distinct src_table, month_key, row_id, premise from refs r
  where premise is not null and not exists (select 1 from lives l where l.name = r.premise and l.since <= r.seen and l.until > r.seen))"""

SQL = {
    "p1_premises": f"with {_REFS} select premise, count(*) n_references, count(distinct step_id) n_steps, count(distinct theorem) n_theorems from refs where premise is not null group by 1",
    "p1_in_degrees": f"with {_ENTRIES} select in_degree, count(*) n_entries, count(distinct premise) n_premises from entries where in_degree is not null group by 1",
    "p1_modes": f"""with {_REFS}, w as (select premise, theorem, count(*) n from refs where premise is not null group by 1, 2)
select premise, theorem, n n_references from w qualify row_number() over (partition by premise order by n desc, theorem nulls last) = 1""",
    "p1_percentiles": f"""with {_ENTRIES}, shares as (select unnest([0.5::double, 0.9::double]) share)
select premise, share, quantile_disc(in_degree, 0.5) in_degree from entries, shares where premise is not null and in_degree is not null and share = 0.5 group by 1, 2
union all
select premise, share, quantile_disc(in_degree, 0.9) from entries, shares where premise is not null and in_degree is not null and share = 0.9 group by 1, 2""",
    "p1_found": f"""with {_REFS}, {_ENTRIES}
select 'premises' src_field, premise key_value from refs where premise is not null group by 2 having count(*) * 100.0 >= 1.5 * (select count(*) from refs where premise is not null)
union all
select 'in_degree', in_degree::varchar from entries where in_degree is not null group by in_degree having count(*) * 100.0 >= 5 * (select count(*) from entries where in_degree is not null)""",
    "p2_found": f"with {_P2} select * from found",
    "p2_months": f"with {_P2} select src_table, month_key, count(*) n_orphans from found group by 1, 2",
}
