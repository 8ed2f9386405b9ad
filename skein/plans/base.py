"""The shapes the operators work on, made from the tables of a folder, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_name, clean_names, sql_name
from ..functions.paths import module_of, sql_top_module, top_module
from ..functions.text import normalised, sql_normalised, token_stream
from ..operators import graph, labels
from ..sources.tables import first_delivery, table


def steps(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """``name, step_no, step_id`` and the ``fields`` among ``file_path, tactic, premises`` (all by default): one row per step
    that belongs to a name. Only the fields asked for are read and shuffled."""
    raw = table(spark, d, "tactic_steps")
    known = {"file_path": F.coalesce("file_path", F.lit("")), "tactic": F.coalesce("tactic", F.lit("")), "premises": clean_names("premises")}
    kept = first_delivery(raw, "step_id", {"name": clean_name("full_name"), "step_no": F.coalesce("step_no", F.lit(-1)), **{f: known[f] for f in fields or known}})
    return kept.where("name is not null")


def first_paths(s: DataFrame) -> DataFrame:
    """``name, file_path`` of the first step of each proof."""
    return s.groupBy("name").agg(F.min_by("file_path", F.struct("step_no", "step_id")).alias("file_path"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """``name, kind, file_path``: the last row of each declaration."""
    c = table(spark, d, "corpus").select(clean_name("full_name").alias("name"), "ord", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("file_path", F.lit("")).alias("file_path")).where("name is not null")
    return c.groupBy("name").agg(F.max(F.struct("ord", "kind", "file_path")).alias("v")).select("name", "v.kind", "v.file_path")


def proofs(s: DataFrame) -> DataFrame:
    """``name, tactics``: tactics in order, empty ones dropped; a proof of empty tactics keeps an empty list."""
    ordered = F.array_sort(F.collect_list(F.struct("step_no", "step_id", "tactic")))
    return s.groupBy("name").agg(F.filter(F.transform(ordered, lambda x: x["tactic"]), lambda t: t != "").alias("tactics"))


def abstract_proofs(s: DataFrame) -> DataFrame:
    """``name, items``: the same with every tactic normalised, before the shuffle."""
    return proofs(s.select("name", "step_no", "step_id", normalised("tactic").alias("tactic"))).withColumnRenamed("tactics", "items")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """``name, cid``: one row a name, the least cluster where there are several."""
    c = table(spark, d, "clusters").select(clean_name("full_name").alias("name"), "cid").where("name is not null and cid is not null")
    return c.groupBy("name").agg(F.min("cid").alias("cid"))


def edges(s: DataFrame) -> DataFrame:
    return graph.edges_of(s)


def nodes(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """``name, file_path, module``."""
    premises = s.select(F.explode("premises").alias("name"))
    return graph.node_union(corpus(spark, d), first_paths(s), premises).withColumn("module", module_of("file_path"))


def members(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """``cid, name, module`` (top module) of the clustered names; ``Unknown`` where no path is known."""
    n = nodes(spark, d, s).select("name", "file_path")
    return clusters(spark, d).join(n, "name", "left").select("cid", "name", top_module("file_path").alias("module"))


def labelled(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    return labels.labels(labels.distribution(members(spark, d, s), ["cid"]), ["cid"])


def recorded_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels as an earlier run recorded them, in the shape of ``labelled``."""
    mods = F.transform("top_modules", lambda m: F.struct(m["module_name"].alias("module"), m["cnt"].alias("cnt")))
    return table(spark, d, "cluster_labels").select("cid", "label", "dominant_module", "dominant_fraction", "entropy", "norm_entropy", "is_mixed", F.col("cluster_size").alias("size"), mods.alias("top_modules"))


def event_sequences(spark: SparkSession, d: str) -> DataFrame:
    """``name, cid, items``: the event types of each user in order; the cluster is the user's id modulo 10."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("items"))
    return e.select(F.col("name").cast("string").alias("name"), (F.col("name") % 10).cast("int").alias("cid"), "items")


def streams(spark: SparkSession, d: str) -> DataFrame:
    """``cid, n_steps, items``: the token stream of each clustered proof."""
    p = abstract_proofs(steps(spark, d, "tactic")).join(clusters(spark, d), "name")
    return p.select("cid", F.size("items").alias("n_steps"), token_stream("items").alias("items"))


ST = f"""st as (select step_id, name, step_no, file_path, tactic, premises from (
  select step_id, {sql_name('full_name')} as name, coalesce(step_no, -1) as step_no, coalesce(file_path, '') as file_path, coalesce(tactic, '') as tactic, premises,
    row_number() over (partition by step_id order by ord) rn from tactic_steps where step_id is not null) where rn = 1 and name is not null)"""
CORPUS = f"""co as (select name, arg_max(coalesce(kind, ''), ord) kind, arg_max(coalesce(file_path, ''), ord) file_path from (select {sql_name('full_name')} as name, kind, file_path, ord from corpus) where name is not null group by 1)"""
EDGES = f"ed as (select distinct src, dst from (select name src, {sql_name('p')} dst from (select name, unnest(premises) p from st)) where dst is not null and dst <> src)"
NODES = f"""fp as (select name, arg_min(file_path, {{'a': step_no, 'b': step_id}}) file_path from st group by 1),
nd as (select name, arg_max(file_path, prio) file_path from (
  select name, file_path, 1 prio from co union all select name, file_path, 2 from fp
  union all select {sql_name('p')}, '', 0 from (select unnest(premises) p from st)) where name is not null group by 1)"""
CLUSTERS = f"cm as (select name, min(cid) cid from (select {sql_name('full_name')} as name, cid from clusters) where name is not null and cid is not null group by 1)"
LABELS = f"""mods as (select cid, module, count(*) cnt from (select cm.cid, {sql_top_module('nd.file_path')} as module from cm left join nd on nd.name = cm.name) group by 1, 2),
rk as (select *, row_number() over (partition by cid order by cnt desc, module) rank, (sum(cnt) over (partition by cid))::bigint total from mods),
lab as (select *, case when k > 1 then entropy / log2(k) else entropy end norm_entropy, dominant_fraction < 0.4 is_mixed, case when dominant_fraction < 0.4 then top3 else dominant_module end as label from (
  select cid, max(case when rank = 1 then module end) dominant_module, max(cnt) / max(total)::double dominant_fraction, abs(sum(cnt / total::double * log2(cnt / total::double))) entropy, count(*) k, max(total) size,
    string_agg(case when rank <= 3 then module end, ' + ' order by rank) top3, string_agg(case when rank <= 5 then module || ':' || cnt end, ',' order by rank) top_modules from rk group by 1)),
pure as (select cid from lab where not is_mixed and round(dominant_fraction, 3) >= 0.5)"""
PROOFS = "pr as (select name, coalesce(list(tactic order by step_no, step_id) filter (tactic <> ''), []) tactics from st group by 1)"
ABSTRACT = f"""dt as (select tactic, {sql_normalised('tactic')} as n from (select distinct tactic from st)),
ab as (select name, coalesce(list(n order by step_no, step_id) filter (n <> ''), []) items from st join dt using (tactic) group by 1)"""
GRAPH = ",\n".join([ST, CORPUS, EDGES, NODES, CLUSTERS])
ALL = f"{GRAPH},\n{LABELS}"
RECORDED = f"""{GRAPH},
lab as (select *, cluster_size size from cluster_labels),
tmod as (select cid, m.cnt cnt from (select cid, unnest(top_modules) m from cluster_labels)),
pure as (select cid from lab where not is_mixed and round(dominant_fraction, 3) >= 0.5)"""
EVENTS = "es as (select user_id::varchar as name, (user_id % 10)::int cid, list(event_type order by ts, event_id) items from events group by user_id)"
