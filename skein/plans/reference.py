"""Queries of the graph, label, n-gram, bridge, similarity, validation and complexity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.names import clean_name, leading_word, tokens
from ..functions.paths import module_of, second_part, top_module
from ..operators import bridges, charts, community, complexity, graph, labels, ngrams, reports, similarity, validation
from ..sources.shared import written
from ..sources.tables import table
from ..streaming import arrivals
from . import base

QUERIES: dict = {}
#: A hand-made pair of sides in this project's names, as the known bridges of mathematics don't occur in them.
SIDES = {"mesh / fold": {"mesh": ["mesh."], "fold": ["fold."]}, "norm / trace": {"norm": ["norm_", ".norm"], "trace": ["trace"]}, "left / missing": {"left": ["_left"], "missing": ["Brouwer"]}}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def joined(c: str, sep: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# graph construction


@query
def corpus_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return base.corpus(spark, d)


@query
def first_value_per_key(spark, d):
    return base.first_paths(base.steps(spark, d, "file_path"))


@query
def proof_sequences(spark, d):
    return base.proofs(base.steps(spark, d, "tactic")).select("name", F.size("tactics").cast("long").alias("n_tactics"), F.array_join("tactics", "\n").alias("tactics"))


@query
def graph_nodes(spark, d):
    return base.nodes(spark, d, base.steps(spark, d, "file_path", "premises"))


@query
def graph_edges(spark, d):
    return base.edges(base.steps(spark, d, "premises"))


@query
def graph_size(spark, d):
    s = base.steps(spark, d, "file_path", "premises")
    both = base.nodes(spark, d, s).select(F.lit(1).alias("node")).unionByName(base.edges(s).select(F.lit(0).alias("node")))
    return both.agg(F.count_if(F.col("node") == 1).alias("n_nodes"), F.count_if(F.col("node") == 0).alias("n_edges"))


@query
def in_degree(spark, d):
    s = base.steps(spark, d, "file_path", "premises")
    return graph.in_degrees(base.nodes(spark, d, s), base.edges(s))


@query
def indegree_p90(spark, d):
    return bridges.indegree_p90(in_degree(spark, d))


@query
def indegree_histogram(spark, d):
    return bridges.indegree_histogram(in_degree(spark, d))


@query
def undirected_edges(spark, d):
    return graph.undirected_edges(base.edges(base.steps(spark, d, "premises")))


@query
def induced_subgraph(spark, d):
    return graph.induced(base.edges(base.steps(spark, d, "premises")), base.clusters(spark, d))


@query
def node_index(spark, d):
    """Contiguous numbers of the clusters, by id."""
    c = base.clusters(spark, d).select("cid").distinct()
    return c.select("cid", (F.row_number().over(Window.orderBy("cid")) - 1).cast("long").alias("idx"))  # a few hundred rows


# graph algorithms


@query
def connected_components(spark, d):
    """Components of the whole dependency graph, single declarations included."""
    s = base.steps(spark, d, "file_path", "premises")
    return graph.connected_components(base.edges(s), base.nodes(spark, d, s).select("name"))


@query
def largest_component(spark, d):
    return graph.largest_component(written(connected_components(spark, d))).select("node")


@query
def component_sizes(spark, d):
    return connected_components(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


@query
def communities(spark, d):
    return community.communities(base.edges(base.steps(spark, d, "premises")))


@query
def modularity(spark, d):
    made = community.modularity(graph.undirected_edges(base.edges(base.steps(spark, d, "premises"))), base.clusters(spark, d))
    return made.select(r6("modularity").alias("modularity"))


@query
def sub_lcc_status(spark, d):
    return graph.component_flags(base.edges(base.steps(spark, d, "premises")), base.clusters(spark, d))


@query
def sub_communities(spark, d):
    s = base.steps(spark, d, "premises")
    return community.sub_communities(base.edges(s), base.clusters(spark, d))


@query
def sub_cluster_labels(spark, d):
    s = base.steps(spark, d, "file_path", "premises")
    subs = community.sub_communities(base.edges(s), base.clusters(spark, d))
    placed = subs.join(base.nodes(spark, d, s).select("name", "file_path"), "name", "left").select("top", "sub", top_module("file_path", []).alias("module"))
    return shown(labels.labels(labels.distribution(placed, ["top", "sub"]), ["top", "sub"], top=3), "top", "sub")


# labels


def shown(labelled: DataFrame, *keys: str) -> DataFrame:
    mods = F.array_join(F.transform("top_modules", lambda m: F.concat(m["module"], F.lit(":"), m["cnt"].cast("string"))), ",")
    return labelled.select(*keys, "label", "dominant_module", *[r6(c).alias(c) for c in ("dominant_fraction", "entropy", "norm_entropy")], "is_mixed", "size", mods.alias("top_modules"))


@query
def module_from_path(spark, d):
    p = table(spark, d, "tactic_steps").select("file_path").distinct()
    return p.select("file_path", module_of("file_path").alias("module"))


@query
def module_parts(spark, d):
    """Both rules for the top module, and element 1 of the dotted module."""
    p = table(spark, d, "tactic_steps").select("file_path").distinct()
    return p.select("file_path", top_module("file_path").alias("top_module"), top_module("file_path", []).alias("top_module_sub"), second_part(module_of("file_path")).alias("summary_module"))


@query
def cluster_summary(spark, d):
    s = base.steps(spark, d, "file_path", "premises")
    named = base.clusters(spark, d).join(base.nodes(spark, d, s), "name", "left").select("cid", second_part(F.coalesce("module", F.lit(""))).alias("module"))
    top = labels.top_modules(labels.distribution(named.where("module is not null"), ["cid"]), ["cid"])
    mods = F.array_join(F.transform("top_modules", lambda m: F.concat(m["module"], F.lit(":"), m["cnt"].cast("string"))), ",")
    return named.groupBy("cid").agg(F.count(F.lit(1)).alias("size")).join(top, "cid", "left").select("cid", "size", F.coalesce(mods, F.lit("")).alias("top_modules"))


@query
def module_distribution(spark, d):
    return labels.distribution(base.members(spark, d, base.steps(spark, d, "file_path", "premises")), ["cid"])


@query
def cluster_labels(spark, d):
    return shown(base.labelled(spark, d, base.steps(spark, d, "file_path", "premises")), "cid")


@query
def mixed_pure_counts(spark, d):
    return labels.mixed_pure_counts(base.labelled(spark, d, base.steps(spark, d, "file_path", "premises")))


@query
def pure_clusters(spark, d):
    return labels.pure(base.labelled(spark, d, base.steps(spark, d, "file_path", "premises"))).select("cid")


@query
def source_labels(spark, d):
    """The same labels for the sources of the documents, by language."""
    m = table(spark, d, "documents").select(F.coalesce("source", F.lit("?")).alias("cid"), F.coalesce("lang", F.lit("?")).alias("module"))
    return shown(labels.labels(labels.distribution(m, ["cid"]), ["cid"]), "cid")


# text


@query
def anchor_extract(spark, d):
    """Contents of anchors; an anchor that isn't closed on its line is none."""
    t = table(spark, d, "tactic_steps").select("ord", F.explode(text.anchors("tactic")).alias("anchor"))
    return t.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


@query
def anchor_extract_joined(spark, d):
    """The same with line breaks as blanks, for texts whose anchors were broken over lines."""
    t = table(spark, d, "tactic_steps").select("ord", F.explode(text.anchors(F.translate("tactic", "\n", " "))).alias("anchor"))
    return t.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))


@query
def anchor_clean(spark, d):
    return table(spark, d, "tactic_steps").select("ord", text.without_anchors("tactic").alias("tactic"))


@query
def whitespace_collapse(spark, d):
    return table(spark, d, "tactic_steps").where("tactic is not null").select("ord", text.collapsed("tactic").alias("tactic"))


@query
def normalize_text(spark, d):
    return table(spark, d, "tactic_steps").where("tactic is not null").select("tactic").distinct().select("tactic", text.normalised("tactic").alias("normal"))


@query
def tokenise(spark, d):
    return table(spark, d, "tactic_steps").select("ord", F.array_join(tokens("tactic"), " ").alias("tokens"))


@query
def token_stream(spark, d):
    p = base.proofs(base.steps(spark, d, "tactic"))
    return p.select("name", F.array_join(text.token_stream("tactics"), " ").alias("tokens"))


# n-grams and bridges


def gram_text(c: str = "gram") -> Column:
    return F.array_join(c, " | ")


@query
def ngrams_of_words(spark, d):
    s = base.steps(spark, d, "tactic").withColumn("tactic", F.coalesce(leading_word("tactic"), F.lit("")))
    g = base.proofs(s).select(F.explode(ngrams.windows("tactics", 3)).alias("gram"))
    return g.groupBy(gram_text().alias("gram")).agg(F.count(F.lit(1)).alias("cnt"))


def _profiles(spark, d, lengths):
    return ngrams.profiles(base.abstract_proofs(base.steps(spark, d, "tactic")).join(base.clusters(spark, d), "name").select("cid", "items"), lengths)


@query
def ngram_profile(spark, d):
    return _profiles(spark, d, [3]).select("n", "cid", gram_text().alias("gram"), "cnt")


@query
def ngram_sweep(spark, d):
    s = ngrams.sweep(base.streams(spark, d))
    return s.select("n", "total_unique", *[r6(c).alias(c) for c in ("frac_ge2", "frac_ge3", "frac_ge5", "median_clusters", "p90_clusters")], "max_clusters")


@query
def best_n(spark, d):
    return ngrams.best_n(ngrams.sweep(base.streams(spark, d)))


@query
def generic_filter(spark, d):
    p = _profiles(spark, d, [3]).select("gram").distinct()
    return p.where(text.all_generic("gram")).select(gram_text().alias("gram"))


def _shown_bridges(b):
    return b.select("n", gram_text().alias("gram"), "n_clusters", *[r6(c).alias(c) for c in ("h_norm", "rarity", "bridge_score", "mean_relative_freq")], F.array_join(F.transform("cluster_counts", lambda x: F.concat_ws(":", x["cid"].cast("string"), x["cnt"].cast("string"))), ",").alias("cluster_counts"))


@query
def bridge_scores(spark, d):
    """All shared n-grams of 3, 4 and 5 tactics, as the standalone run finds them."""
    return _shown_bridges(bridges.gram_bridges(written(_profiles(spark, d, [3, 4, 5])), top_k=None))


@query
def bridge_list(spark, d):
    """The pipeline's list: lengths best n and the next, at least 3 occurrences in a cluster."""
    n = ngrams.best_n(ngrams.sweep(base.streams(spark, d))).first()[0]
    return _shown_bridges(bridges.gram_bridges(written(_profiles(spark, d, [n, n + 1])), min_count=3))


@query
def event_bridges(spark, d):
    p = ngrams.profiles(base.event_sequences(spark, d).select("cid", "items"), [3, 4])
    return _shown_bridges(bridges.gram_bridges(written(p), top_k=None, filter_generic=False))


@query
def event_sweep(spark, d):
    e = base.event_sequences(spark, d).select("cid", F.size("items").alias("n_steps"), "items")
    s = ngrams.sweep(e)
    return s.select("n", "total_unique", *[r6(c).alias(c) for c in ("frac_ge2", "frac_ge3", "frac_ge5", "median_clusters", "p90_clusters")], "max_clusters")


def _graph(spark, d):
    """Steps and edges, each computed once, clusters, recorded labels and pure clusters."""
    s = written(base.steps(spark, d, "file_path", "premises"))
    labelled = base.recorded_labels(spark, d)
    return s, written(base.edges(s)), base.clusters(spark, d), labelled, labels.pure(labelled).select("cid")


@query
def bridge_theorems(spark, d):
    _, e, c, lab, pure = _graph(spark, d)
    b = bridges.bridge_theorems(e, c, lab, pure)
    return b.select("theorem", "self_cluster", "self_label", "n_premise_clusters", joined("premise_cluster_ids").alias("premise_cluster_ids"), joined("premise_cluster_labels", ";").alias("premise_cluster_labels"), "n_premises")


@query
def bridge_pair_counts(spark, d):
    _, e, c, lab, pure = _graph(spark, d)
    return bridges.pair_counts(written(bridges.bridge_theorems(e, c, lab, pure, top_k=None)))


def _candidates(spark, d):
    s, e, c, lab, pure = _graph(spark, d)
    degrees = written(graph.in_degrees(base.nodes(spark, d, s), e))
    return written(bridges.depth_candidates(e, c, pure, degrees)), degrees, c, lab, (e, pure)


@query
def depth_candidates(spark, d):
    c = _candidates(spark, d)[0]
    return c.select("theorem", "n_clusters", "min_cross_indegree", F.array_join(F.transform("cross_premises", lambda p: F.concat_ws(":", p["premise"], p["cid"].cast("string"), p["in_degree"].cast("string"))), ",").alias("cross_premises"))


@query
def indegree_sweep(spark, d):
    c, degrees, *_ = _candidates(spark, d)
    return bridges.indegree_sweep(c, degrees)


@query
def elbow_theta(spark, d):
    c, degrees, *_ = _candidates(spark, d)
    return bridges.elbow(bridges.indegree_sweep(c, degrees))


@query
def filtered_bridges(spark, d):
    c, degrees, *_ = _candidates(spark, d)
    theta = bridges.elbow(bridges.indegree_sweep(c, degrees)).first()[0]
    return bridges.filtered(c, theta).select("theorem", "n_clusters", "min_cross_indegree")


# similarity


def _event_codes(spark, d):
    p = written(base.event_sequences(spark, d).where(F.size("items") >= similarity.LEAST_STEPS))
    return written(similarity.coded(similarity.top_proofs(p, similarity.top_clusters(p))))


def _proof_codes(spark, d):
    s = written(base.steps(spark, d, "tactic"))
    p = written(base.abstract_proofs(s).where(F.size("items") >= similarity.LEAST_STEPS).join(base.clusters(spark, d), "name"))
    return written(similarity.coded(similarity.top_proofs(p, similarity.top_clusters(p))))


def _distances(c):
    p = c.alias("x").join(c.alias("y"), (F.col("x.cid") == F.col("y.cid")) & (F.col("x.rn") < F.col("y.rn")))
    return p.select(F.col("x.cid").alias("cid"), F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"), F.levenshtein("x.code", "y.code").cast("long").alias("edits"), r6(similarity.distance(F.col("x.code"), F.col("y.code"), F.col("x.len"), F.col("y.len"))).alias("norm_edit_dist"))


def _bridges_of_events(spark, c):
    none = spark.createDataFrame([], "cid int, label string")
    b = similarity.edit_bridges(c, none)
    return b.select("cluster_a", "cluster_b", "theorem_a", "theorem_b", r6("norm_edit_dist").alias("norm_edit_dist"), r6("surprise").alias("surprise"))


@query
def top_clusters(spark, d):
    return similarity.top_clusters(base.abstract_proofs(base.steps(spark, d, "tactic")).where(F.size("items") >= similarity.LEAST_STEPS).join(base.clusters(spark, d), "name")).select("cid", "n_proofs")


@query
def top_proofs_per_cluster(spark, d):
    p = written(base.abstract_proofs(base.steps(spark, d, "tactic")).where(F.size("items") >= similarity.LEAST_STEPS).join(base.clusters(spark, d), "name"))
    return similarity.top_proofs(p, similarity.top_clusters(p)).select("cid", "name", F.col("len").cast("long").alias("len"), F.col("rn").cast("long").alias("rn"))


@query
def token_edit_distance(spark, d):
    """Distances between the ``PER_CLUSTER`` longest sequences of each cluster of users."""
    return _distances(_event_codes(spark, d))


@query
def proof_edit_distance(spark, d):
    """Distances between the ``PER_CLUSTER`` longest proofs of each cluster."""
    return _distances(_proof_codes(spark, d))


@query
def edit_baseline(spark, d):
    return similarity.baseline(_event_codes(spark, d)).select(r6("baseline").alias("baseline"))


@query
def proof_edit_baseline(spark, d):
    return similarity.baseline(_proof_codes(spark, d)).select(r6("baseline").alias("baseline"))


@query
def event_edit_bridges(spark, d):
    """Bridges between the ``PER_CLUSTER`` longest sequences of each cluster of users."""
    return _bridges_of_events(spark, _event_codes(spark, d))


@query
def edit_bridges(spark, d):
    return similarity.edit_bridges(_proof_codes(spark, d), base.recorded_labels(spark, d)).drop("seq_a", "seq_b")


# validation


@query
def pattern_search(spark, d):
    return validation.matches(base.clusters(spark, d).select("name"), validation.patterns(spark, SIDES))


@query
def bridge_span(spark, d):
    c = base.clusters(spark, d)
    known = validation.patterns(spark, SIDES)
    return validation.span(validation.matches(c.select("name"), known), c, known)


@query
def validation_summary(spark, d):
    c = base.clusters(spark, d)
    found = validation.matches(c.select("name"), validation.patterns(spark, SIDES))
    made = validation.summary(found, c, base.recorded_labels(spark, d))
    return made.select("bridge", "side", "cid", "label", "n_matches", joined("theorems").alias("theorems"))


@query
def detected_matches(spark, d):
    c, *_ = _candidates(spark, d)
    found = validation.matches(base.clusters(spark, d).select("name"), validation.patterns(spark, SIDES))
    return validation.detected(found, c)


def _verdicts(spark, d, known):
    cand, degrees, c, lab, (e, pure) = _candidates(spark, d)
    theta = bridges.elbow(bridges.indegree_sweep(cand, degrees)).first()[0]
    pats = validation.patterns(spark, known)
    found = written(validation.matches(c.select("name"), pats))
    strict = validation.detected(found, bridges.filtered(cand, theta))
    loose = validation.detected(found, bridges.bridge_theorems(e, c, lab, pure, top_k=None))
    return validation.verdicts(validation.span(found, c, pats), strict, loose)


@query
def validation_verdicts(spark, d):
    return _verdicts(spark, d, SIDES)


@query
def known_bridge_verdicts(spark, d):
    return _verdicts(spark, d, None)


# complexity


def _interaction(spark, d):
    """Interaction by the bridges that the in-degree filter leaves, as in the pipeline."""
    cand, degrees, c, lab, _ = _candidates(spark, d)
    theta = bridges.elbow(bridges.indegree_sweep(cand, degrees)).first()[0]
    return written(complexity.interaction(bridges.filtered(cand, theta), c, lab)), lab


@query
def interaction_matrix(spark, d):
    return _interaction(spark, d)[0]


@query
def integration(spark, d):
    made = complexity.integration(*_interaction(spark, d))
    return made.select("cid", r6("integration").alias("integration"), "total_bridge_connections")


@query
def differentiation(spark, d):
    return complexity.differentiation(base.recorded_labels(spark, d)).select("cid", r6("differentiation").alias("differentiation"))


@query
def neural_complexity(spark, d):
    made = complexity.complexity(*_interaction(spark, d))
    return made.select("cid", "label", "size", *[r6(c).alias(c) for c in ("integration", "differentiation", "neural_complexity")], "total_bridge_connections", "is_mixed")


@query
def global_cn(spark, d):
    return complexity.global_complexity(*_interaction(spark, d)).select(r6("global_cn").alias("global_cn"))


def _recorded_interaction(spark, d):
    """Interaction by the recorded bridges and labels: labels stand for their first cluster."""
    b = table(spark, d, "bridge_theorems_filtered").groupBy("bridge_id").agg(F.min(F.struct(clean_name("theorem").alias("theorem"), "cross_cluster_premises")).alias("b")).select("b.*")
    lab = base.recorded_labels(spark, d)
    return written(complexity.interaction(complexity.by_label(b.where("theorem is not null"), lab), base.clusters(spark, d), lab)), lab


@query
def recorded_interaction_matrix(spark, d):
    return _recorded_interaction(spark, d)[0]


@query
def recorded_complexity(spark, d):
    made = complexity.complexity(*_recorded_interaction(spark, d))
    return made.select("cid", *[r6(c).alias(c) for c in ("integration", "neural_complexity")], "total_bridge_connections")


# charts and reports


def _recorded_bridges(spark, d):
    return table(spark, d, "bridges").select(F.col("bridge_no").alias("bridge_id"), "bridge_score", F.map_keys("cluster_counts").alias("cids"))


@query
def cluster_graph_edges(spark, d):
    return charts.cluster_edges(_recorded_bridges(spark, d)).select("cid_a", "cid_b", r6("weight").alias("weight"))


@query
def plot_cluster_edges(spark, d):
    e = written(charts.cluster_edges(_recorded_bridges(spark, d)))
    return charts.edge_widths(e, base.labelled(spark, d, base.steps(spark, d, "file_path", "premises"))).select("cid_a", "cid_b", r6("width").alias("width"))


@query
def plot_cluster_nodes(spark, d):
    n = charts.cluster_nodes(base.labelled(spark, d, base.steps(spark, d, "file_path", "premises")))
    return n.select("cid", r6("node_size").alias("node_size"), "colour", "shown_label")


@query
def plot_legend(spark, d):
    return charts.legend(base.recorded_labels(spark, d))


@query
def plot_purity(spark, d):
    p = charts.purity(base.labelled(spark, d, base.steps(spark, d, "file_path", "premises")))
    return p.select("cid", *[r6(c).alias(c) for c in ("dominant_fraction", "norm_entropy", "marker_size")], "colour", "shown_label", "left_of_line")


def _bars(subs: DataFrame) -> DataFrame:
    return charts.hierarchy(written(subs)).select("top", "sub", F.col("bar").cast("long").alias("bar"), "total", r6("fraction").alias("fraction"), r6("left").alias("left"), "shown_label")


@query
def plot_hierarchy(spark, d):
    """Stacked bars of the communities inside each cluster."""
    return _bars(sub_cluster_labels(spark, d).select("top", "sub", "label", "size"))


@query
def plot_module_bars(spark, d):
    """The same bars of the modules inside each cluster, which SQL can follow."""
    r = labels.ranked(labels.distribution(base.members(spark, d, base.steps(spark, d, "file_path", "premises")), ["cid"]), ["cid"])
    subs = r.select(F.col("cid").alias("top"), (F.col("rank") - 1).alias("sub"), F.col("module").alias("label"), F.col("cnt").alias("size"))
    return _bars(subs)


@query
def plot_complexity(spark, d):
    p = charts.complexity_points(complexity.complexity(*_interaction(spark, d)))
    return p.select("cid", "marker_size", r6("neural_complexity").alias("neural_complexity"), "in_bars")


@query
def label_report(spark, d):
    lab = base.labelled(spark, d, base.steps(spark, d, "file_path", "premises"))
    return reports.lines(lab, [F.desc("size"), F.col("cid")], "%3d  C%-4d %6d  %s", F.col("cid"), F.col("size"), reports.shortened("label"))


@query
def bridge_theorem_report(spark, d):
    _, e, c, lab, pure = _graph(spark, d)
    return reports.of_theorems(bridges.bridge_theorems(e, c, lab, pure))


@query
def filtered_report(spark, d):
    c, degrees, _, lab, _ = _candidates(spark, d)
    theta = bridges.elbow(bridges.indegree_sweep(c, degrees)).first()[0]
    return reports.of_candidates(bridges.filtered(c, theta), lab, theta)


@query
def event_windows(spark, d):
    """Events per hour and type, the batch form of the stream."""
    made = arrivals.event_windows(table(spark, d, "events"))
    return made.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))
