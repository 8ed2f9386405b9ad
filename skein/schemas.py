"""Schemas of the entities, as Spark DDL."""

RAW_CORPUS = "path STRING, premises ARRAY<STRUCT<full_name: STRING, kind: STRING>>"
CORPUS = "full_name STRING, kind STRING, file_path STRING"
RAW_STEPS = "tactic STRING, full_name STRING, file_path STRING"
STEPS = "full_name STRING, file_path STRING, tactic STRING, premises ARRAY<STRING>, split STRING"
NODES = "name STRING, file_path STRING, module STRING"
EDGES = "src STRING, dst STRING"
PROOFS = "name STRING, items ARRAY<STRING>"
CLUSTERS = "name STRING, cid INT"
LABELS = "cid INT, label STRING, dominant_module STRING, dominant_fraction DOUBLE, entropy DOUBLE, norm_entropy DOUBLE, is_mixed BOOLEAN, size LONG, top_modules ARRAY<STRUCT<module: STRING, cnt: LONG>>"
SUB_CLUSTERS = "name STRING, top INT, sub INT"
PROFILES = "n INT, gram ARRAY<STRING>, cid INT, cnt LONG"
SWEEP = "n INT, total_unique LONG, frac_ge2 DOUBLE, frac_ge3 DOUBLE, frac_ge5 DOUBLE, median_clusters DOUBLE, p90_clusters DOUBLE, max_clusters LONG"
BRIDGES = "n INT, gram ARRAY<STRING>, n_clusters LONG, h_norm DOUBLE, rarity DOUBLE, bridge_score DOUBLE, mean_relative_freq DOUBLE, cluster_counts ARRAY<STRUCT<cid: INT, cnt: LONG>>"
BRIDGE_THEOREMS = "theorem STRING, self_cluster INT, self_label STRING, n_premise_clusters LONG, premise_cluster_ids ARRAY<INT>, premise_cluster_labels ARRAY<STRING>, n_premises LONG"
CANDIDATES = "theorem STRING, n_clusters LONG, min_cross_indegree LONG, cross_premises ARRAY<STRUCT<premise: STRING, cid: INT, in_degree: LONG>>"
INDEGREE_SWEEP = "theta LONG, count LONG"
EDIT_BRIDGES = "cluster_a INT, cluster_b INT, label_a STRING, label_b STRING, theorem_a STRING, theorem_b STRING, norm_edit_dist DOUBLE, surprise DOUBLE, seq_a ARRAY<STRING>, seq_b ARRAY<STRING>"
PATTERNS = "bridge STRING, side INT, pattern STRING"
INTERACTION = "i INT, j INT, weight LONG"
COMPLEXITY = "cid INT, label STRING, size LONG, integration DOUBLE, differentiation DOUBLE, neural_complexity DOUBLE, total_bridge_connections LONG, is_mixed BOOLEAN"
