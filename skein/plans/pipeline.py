"""The whole analysis in steps, each a Parquet table that a later run takes up again. ``sources.formats.ingest`` makes the
input tables from raw JSON lines; ``python -m skein`` runs all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import top_module
from ..functions.text import token_stream
from ..operators import bridges, charts, community, complexity, graph, labels, ngrams, reports, similarity, validation
from ..sources.formats import exists, read_first, write_json, write_map, write_report, write_table
from ..schemas import CANDIDATES
from . import base

Get = Callable[[str], DataFrame]


def _hierarchy_labels(get: Get) -> DataFrame:
    placed = get("sub_clusters").join(get("nodes").select("name", "file_path"), "name", "left").select("top", "sub", top_module("file_path", []).alias("module"))
    return labels.labels(labels.distribution(placed, ["top", "sub"]), ["top", "sub"], top=3)


def _labels(get: Get) -> DataFrame:
    m = get("clusters").join(get("nodes").select("name", "file_path"), "name", "left").select("cid", top_module("file_path").alias("module"))
    return labels.labels(labels.distribution(m, ["cid"]), ["cid"])


def _items(get: Get) -> DataFrame:
    return get("proofs").join(get("clusters"), "name")


def _sweep(get: Get) -> DataFrame:
    return ngrams.sweep(_items(get).select("cid", F.size("items").alias("n_steps"), token_stream("items").alias("items")))


def _bridges(get: Get) -> DataFrame:
    n = ngrams.best_n(get("sweep")).first()[0]
    return bridges.gram_bridges(ngrams.profiles(_items(get).select("cid", "items"), [n, n + 1]), min_count=3)


def _pure(get: Get) -> DataFrame:
    return labels.pure(get("labels")).select("cid")


def _codes(get: Get) -> DataFrame:
    p = _items(get).where(F.size("items") >= similarity.LEAST_STEPS)
    return similarity.coded(similarity.top_proofs(p, similarity.top_clusters(p)))


def _theta(get: Get) -> int:
    return bridges.elbow(get("indegree_sweep")).first()[0]


def _matches(get: Get) -> tuple[DataFrame, DataFrame]:
    pats = validation.patterns(get("nodes").sparkSession)
    return validation.matches(get("clusters").select("name"), pats), pats


def _detected(get: Get) -> DataFrame:
    """Every match among the filtered bridges and among all bridge theorems."""
    strict, loose = (validation.detected(get("matches"), get(t)) for t in ("filtered", "bridge_theorems"))
    return strict.withColumn("detector", F.lit("strict")).unionByName(loose.withColumn("detector", F.lit("loose")))


def _by(get: Get, detector: str) -> DataFrame:
    return get("detected").where(F.col("detector") == detector)


def _verdicts(get: Get) -> DataFrame:
    spans = validation.span(get("matches"), get("clusters"), _matches(get)[1])
    return validation.verdicts(spans, _by(get, "strict"), _by(get, "loose"))


def _validation(get: Get) -> DataFrame:
    return validation.report(get("matches"), get("clusters"), _matches(get)[1], _by(get, "strict"), _by(get, "loose"))


def _chart_edges(get: Get) -> DataFrame:
    shared = get("bridges").select(F.struct("n", "gram").alias("bridge_id"), "bridge_score", F.transform("cluster_counts", lambda x: x["cid"]).alias("cids"))
    return charts.edge_widths(charts.cluster_edges(shared), get("labels"))


#: Steps in order: name and how it is made of earlier ones.
STEPS: dict[str, Callable[[SparkSession, str, Get], DataFrame]] = {
    "steps": lambda spark, d, get: base.steps(spark, d),
    "nodes": lambda spark, d, get: base.nodes(spark, d, get("steps")),
    "edges": lambda spark, d, get: base.edges(get("steps")),
    "proofs": lambda spark, d, get: base.abstract_proofs(get("steps")),
    "clusters": lambda spark, d, get: community.communities(get("edges")),
    "labels": lambda spark, d, get: _labels(get),
    "sub_clusters": lambda spark, d, get: community.sub_communities(get("edges"), get("clusters")),
    "sub_labels": lambda spark, d, get: _hierarchy_labels(get),
    "sweep": lambda spark, d, get: _sweep(get),
    "bridges": lambda spark, d, get: _bridges(get),
    "bridge_theorems": lambda spark, d, get: bridges.bridge_theorems(get("edges"), get("clusters"), get("labels"), _pure(get)),
    "degrees": lambda spark, d, get: graph.in_degrees(get("nodes"), get("edges")),
    "candidates": lambda spark, d, get: bridges.depth_candidates(get("edges"), get("clusters"), _pure(get), get("degrees")),
    "indegree_sweep": lambda spark, d, get: bridges.indegree_sweep(get("candidates"), get("degrees")),
    "filtered": lambda spark, d, get: bridges.filtered(get("candidates"), _theta(get)),
    "matches": lambda spark, d, get: _matches(get)[0],
    "detected": lambda spark, d, get: _detected(get),
    "validation": lambda spark, d, get: _validation(get),
    "validation_clusters": lambda spark, d, get: validation.summary(get("matches"), get("clusters"), get("labels")),
    "verdicts": lambda spark, d, get: _verdicts(get),
    "codes": lambda spark, d, get: _codes(get),
    "edit_bridges": lambda spark, d, get: similarity.edit_bridges(get("codes"), get("labels")),
    "interaction": lambda spark, d, get: complexity.interaction(get("filtered"), get("clusters"), get("labels")),
    "complexity": lambda spark, d, get: complexity.complexity(get("interaction"), get("labels")),
    "global_complexity": lambda spark, d, get: complexity.global_complexity(get("interaction"), get("labels")),
    "chart_edges": lambda spark, d, get: _chart_edges(get),
    "chart_nodes": lambda spark, d, get: charts.cluster_nodes(get("labels")),
    "chart_purity": lambda spark, d, get: charts.purity(get("labels")),
    "chart_hierarchy": lambda spark, d, get: charts.hierarchy(get("sub_labels").select("top", "sub", "label", "size")),
    "chart_complexity": lambda spark, d, get: charts.complexity_points(get("complexity")),
}


def report_premises(filtered: DataFrame, theta: int, kept: int = 5) -> DataFrame:
    """The saved form of the filtered bridges: premises of in-degree <= theta, the first ``kept``."""
    low = F.filter("cross_premises", lambda p: p["in_degree"] <= theta)
    return filtered.select("theorem", "n_clusters", "min_cross_indegree", F.slice(low, 1, kept).alias("cross_premises"))


def run(spark: SparkSession, folder: str, out: str, steps: list[str] | None = None, resume: bool = True) -> dict[str, DataFrame]:
    """Make the tables of ``steps`` (all by default) under ``out`` from the input ``folder``, and what they need.

    With ``resume``, a table that was written completely is read, not made again.
    """
    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            path = f"{out}/{name}"
            made[name] = spark.read.parquet(path) if resume and exists(spark, f"{path}/_SUCCESS") else write_table(STEPS[name](spark, folder, get), path)
        return made[name]

    for name in steps or STEPS:
        get(name)
    return made


def export(spark: SparkSession, out: str, to: str) -> None:
    """The small results of a run as JSON and text reports; the filtered bridges fall back to all candidates where missing."""
    at = lambda name: spark.read.parquet(f"{out}/{name}")
    theta = bridges.elbow(at("indegree_sweep")).first()[0]
    filtered = read_first(spark, [f"{out}/filtered", f"{out}/candidates"], CANDIDATES)
    write_json(report_premises(filtered, theta), f"{to}/bridge_theorems_filtered", [F.desc("n_clusters"), F.col("min_cross_indegree"), F.col("theorem")], 200)
    write_json(at("bridges"), f"{to}/bridges", [F.desc("bridge_score"), F.array_join("gram", "\x00")], 600)
    write_json(at("edit_bridges").drop("seq_a", "seq_b"), f"{to}/edit_bridges", [F.col("norm_edit_dist"), F.col("cluster_a"), F.col("cluster_b")], 200)
    write_json(at("sweep"), f"{to}/ngram_sweep", [F.col("n")], 8)
    write_json(at("complexity"), f"{to}/complexity", [F.col("cid")], 100_000)
    write_json(at("global_complexity"), f"{to}/global_complexity", [F.col("global_cn")], 1)
    write_json(at("validation"), f"{to}/validation", [F.col("bridge"), F.col("side")], 1000)
    write_json(at("validation_clusters"), f"{to}/validation_clusters")
    write_json(at("detected"), f"{to}/validation_detected")
    made = {
        "label_report": reports.of_labels(at("labels")), "bridge_report": reports.of_bridges(at("bridges")), "bridge_theorem_report": reports.of_theorems(at("bridge_theorems")),
        "edit_bridge_report": reports.of_edit_bridges(at("edit_bridges")), "filtered_report": reports.of_candidates(filtered, at("labels"), theta),
        "complexity_report": reports.of_complexity(at("complexity")), "validation_report": reports.of_verdicts(at("verdicts")),
    }
    for name, lines in made.items():
        write_report(lines, f"{to}/{name}")
    write_map(at("labels"), "cid", f"{to}/cluster_labels")
