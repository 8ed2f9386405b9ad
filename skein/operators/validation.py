"""Known bridges looked up by name patterns in the clusters and among the detected bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Known bridges between fields, their two sides and substrings of declaration names that belong to a side.
KNOWN_BRIDGES = {
    "Zorn / Choice / Well-Ordering": {
        "Order/Set theory": ["zorn", "Zorn", "WellOrder", "wellOrder", "WellFounded", "linearOrder_of"],
        "Logic/Foundations": ["axiomOfChoice", "exists_maximal", "Classical.choice", "nonempty_iff_ne_empty", "WellOrderExtension"],
    },
    "Galois ↔ Covering spaces": {
        "Field theory / Galois": ["Galois", "galois", "GaloisGroup", "IsGalois", "GaloisCorrespondence", "separableClosure", "normalClosure"],
        "Topology / Covering": ["CoveringSpace", "coveringSpace", "FundamentalGroup", "fundamentalGroup", "UniversalCover", "monodromy"],
    },
    "Stone duality": {
        "Boolean algebra": ["BooleanAlgebra", "BooleanRing", "Stone.ofBoolAlg", "BoolAlg", "Finset.toBoolAlg"],
        "Stone spaces": ["StoneCech", "TotallySeparated", "totallySeparated", "Profinite", "profinite", "StoneSpace"],
    },
    "Pontryagin duality": {
        "Pontryagin / Characters": ["Pontryagin", "pontryagin", "PontryaginDual", "characterGroup", "CharacterGroup", "AddChar", "addChar"],
        "Harmonic analysis": ["fourierTransform", "FourierTransform", "fourier", "Fourier", "fourierSeries"],
    },
    "Fixed-point theorems": {
        "Topology (Brouwer)": ["Brouwer", "brouwer", "fixedPoint", "FixedPoint", "NoRetraction"],
        "Category theory (Lawvere)": ["Lawvere", "lawvere", "CategoryTheory.fixedPoint", "diagonal", "Diagonal"],
    },
    "Gromov-Hausdorff": {
        "Metric geometry": ["GromovHausdorff", "gromovHausdorff", "hausdorffDist", "HausdorffDist", "ghDist"],
        "Topology": ["MetricSpace", "Bounded", "TotallyBounded", "isCompact", "IsCompact"],
    },
    "Spectral theory ↔ Representation theory": {
        "Spectral theory": ["spectrum", "Spectrum", "resolvent", "Resolvent", "eigenspace", "Eigenspace", "spectral"],
        "Representation theory": ["Representation", "representation", "IrreducibleRep", "CharacterOfRep", "Schur", "isotypic"],
    },
    "Lie algebras ↔ Lie groups": {
        "Lie algebras": ["LieAlgebra", "lieAlgebra", "LieBracket", "Engel", "engel", "nilpotent_of_forall"],
        "Lie groups": ["LieGroup", "lieGroup", "expMap", "expMapSphere", "SmoothManifold", "smoothManifold"],
    },
}


def patterns(spark: SparkSession, known: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """``bridge, side, pattern`` with ``side`` 0 or 1."""
    rows = [(b, i, p) for b, sides in (known or KNOWN_BRIDGES).items() for i, (_, ps) in enumerate(sides.items()) for p in ps]
    return spark.createDataFrame(rows, "bridge string, side int, pattern string")


def matches(names: DataFrame, pats: DataFrame) -> DataFrame:
    """``bridge, side, name``: names that contain a pattern of the side, once a side. Patterns are a fixed list of a few
    dozen, so each name is held against all of them where it is read."""
    per = F.array_sort(F.collect_list(F.struct("bridge", "side", "pattern")))
    listed = pats.agg(per.alias("all")).first()[0] or []
    held = F.array(*[F.when(F.contains("name", F.lit(p["pattern"])), F.struct(F.lit(p["bridge"]).alias("bridge"), F.lit(p["side"]).alias("side"))) for p in listed]) if listed else F.array().cast("array<struct<bridge:string,side:int>>")
    return names.select("name", F.explode(F.array_distinct(F.array_compact(held))).alias("h")).select("h.bridge", "h.side", "name")


def span(found: DataFrame, clusters: DataFrame, known: DataFrame) -> DataFrame:
    """Per known bridge: names found on each side, clusters shared, clusters of one side only, and whether neither side's
    clusters lie within the other's."""
    per = found.join(clusters, "name").groupBy("bridge", "side").agg(F.count(F.lit(1)).alias("n"), F.collect_set("cid").alias("cids"))
    sides = known.select("bridge").distinct()
    for i in (0, 1):
        sides = sides.join(per.where(F.col("side") == i).select("bridge", F.col("n").alias(f"n_{i}"), F.col("cids").alias(f"c_{i}")), "bridge", "left")
    none = F.array().cast("array<int>")
    a, b = F.coalesce("c_0", none), F.coalesce("c_1", none)
    shared = F.size(F.array_intersect(a, b)).cast("long")
    apart = F.size(F.array_union(a, b)).cast("long") - shared
    spans = (F.size(F.array_except(a, b)) > 0) & (F.size(F.array_except(b, a)) > 0)
    return sides.select("bridge", F.coalesce("n_0", F.lit(0)).alias("n_a"), F.coalesce("n_1", F.lit(0)).alias("n_b"), shared.alias("clusters_overlap"), apart.alias("clusters_separated"), spans.alias("bridge_spans_clusters"))


def detected(found: DataFrame, theorems: DataFrame) -> DataFrame:
    """Matches among the detected theorems; one that matches both sides stays twice."""
    return found.join(theorems.select(F.col("theorem").alias("name")).distinct(), "name", "left_semi")


def verdicts(spans: DataFrame, strict: DataFrame, loose: DataFrame) -> DataFrame:
    """``bridge, found, spans, detected``: found on both sides, one or none; detected after the depth filter, before, or not."""
    s = strict.groupBy("bridge").agg(F.count(F.lit(1)).alias("s"))
    lo = loose.groupBy("bridge").agg(F.count(F.lit(1)).alias("l"))
    both = spans.join(s, "bridge", "left").join(lo, "bridge", "left")
    a, b = F.col("n_a") > 0, F.col("n_b") > 0
    return both.select("bridge", F.when(a & b, "yes").when(a | b, "partial").otherwise("no").alias("found"), F.when(F.col("bridge_spans_clusters"), "YES").otherwise("no").alias("spans"), F.when(F.col("s") > 0, "YES (strict)").when(F.col("l") > 0, "YES (loose)").otherwise("no").alias("detected"))


def summary(found: DataFrame, clusters: DataFrame, labelled: DataFrame, names: int = 5) -> DataFrame:
    """``bridge, side, cid, label, n_matches, theorems``: matches per cluster, with the first few names."""
    placed = found.join(clusters, "name")
    first = Window.partitionBy("bridge", "side", "cid").orderBy("name")  # only the first few rows of a group reach its task
    best = placed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= names).groupBy("bridge", "side", "cid").agg(F.array_sort(F.collect_list("name")).alias("theorems"))
    per = placed.groupBy("bridge", "side", "cid").agg(F.count(F.lit(1)).alias("n_matches")).join(best, ["bridge", "side", "cid"])
    return per.join(labelled.select("cid", "label"), "cid", "left").select("bridge", "side", "cid", F.coalesce("label", F.col("cid").cast("string")).alias("label"), "n_matches", "theorems")


def report(found: DataFrame, clusters: DataFrame, known: DataFrame, strict: DataFrame, loose: DataFrame, sample: int = 8) -> DataFrame:
    """Per known bridge and side: its patterns, matches and the first ``sample`` of their names, and what the whole bridge spans
    and how it was detected."""
    sides = known.groupBy("bridge", "side").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    first = Window.partitionBy("bridge", "side").orderBy("name")  # only the first few rows of a group reach its task
    names = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= sample).groupBy("bridge", "side").agg(F.array_sort(F.collect_list("name")).alias("sample_theorems"))
    n = found.groupBy("bridge", "side").agg(F.count(F.lit(1)).alias("n_matches"))
    spans = span(found, clusters, known)
    whole = spans.join(verdicts(spans, strict, loose).select("bridge", "found", "detected"), "bridge").drop("n_a", "n_b")
    made = sides.join(n, ["bridge", "side"], "left").join(names, ["bridge", "side"], "left").join(whole, "bridge")
    return made.withColumn("n_matches", F.coalesce("n_matches", F.lit(0))).withColumn("sample_theorems", F.coalesce("sample_theorems", F.array().cast("array<string>")))
