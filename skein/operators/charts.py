"""What the charts show, as frames ready to be drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The colour of each top module in the charts, and that of all others.
COLOURS = {
    "Algebra": "#4C72B0",
    "Analysis": "#DD8452",
    "CategoryTheory": "#55A868",
    "Combinatorics": "#C44E52",
    "Data": "#8172B3",
    "FieldTheory": "#937860",
    "Geometry": "#DA8BC3",
    "GroupTheory": "#8C8C8C",
    "LinearAlgebra": "#CCB974",
    "MeasureTheory": "#64B5CD",
    "ModelTheory": "#e377c2",
    "NumberTheory": "#7f7f7f",
    "Order": "#bcbd22",
    "RingTheory": "#17becf",
    "Topology": "#aec7e8",
    "AlgebraicGeometry": "#ffbb78",
    "AlgebraicTopology": "#98df8a",
    "Computability": "#ff9896",
    "External": "#c5b0d5",
    "Unknown": "#c7c7c7",
}
OTHER_COLOUR = "#c7c7c7"


def first_label(c: str):
    return F.split(c, r" \+ ")[0]


def colour(c: str):
    """Colour of a label, by the first module it names."""
    known = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, first_label(c)), F.lit(OTHER_COLOUR))


def legend(labelled: DataFrame) -> DataFrame:
    """``module, colour``: the modules that stand first in a label."""
    return labelled.select(first_label("label").alias("module"), colour("label").alias("colour")).distinct()


def cluster_edges(bridges: DataFrame) -> DataFrame:
    """``cid_a, cid_b, weight``: sum of the scores of the bridges two clusters share (``bridge_id, bridge_score, cids``)."""
    each = bridges.select("bridge_id", "bridge_score", F.explode("cids").alias("cid"))
    pairs = each.alias("x").join(each.alias("y"), "bridge_id").where("x.cid < y.cid")
    return pairs.groupBy(F.col("x.cid").alias("cid_a"), F.col("y.cid").alias("cid_b")).agg(F.sum("x.bridge_score").alias("weight"))


def edge_widths(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """Edges between labelled clusters with ``width``, the weight scaled to 0.3 .. 2.8."""
    known = labelled.select("cid")
    e = edges.join(known.withColumnRenamed("cid", "cid_a"), "cid_a", "left_semi").join(known.withColumnRenamed("cid", "cid_b"), "cid_b", "left_semi")
    lo, hi = e.agg(F.min("weight"), F.max("weight")).first()
    if lo is None:
        return e.select("cid_a", "cid_b", "weight", F.lit(None).cast("double").alias("width"))
    return e.select("cid_a", "cid_b", "weight", (0.3 + 2.5 * (F.col("weight") - lo) / (hi - lo + 1e-12)).alias("width"))


def cluster_nodes(labelled: DataFrame, shown_from: int = 300) -> DataFrame:
    return labelled.select("cid", (F.sqrt("size") * 8).alias("node_size"), colour("label").alias("colour"), F.when(F.col("size") > shown_from, F.col("label")).alias("shown_label"))


def purity(labelled: DataFrame, named_from: int = 1000) -> DataFrame:
    return labelled.select("cid", "dominant_fraction", "norm_entropy", (F.sqrt("size") * 5).alias("marker_size"), colour("label").alias("colour"), F.when(F.col("size") > named_from, first_label("label")).alias("shown_label"), (F.col("dominant_fraction") < 0.4).alias("left_of_line"))


def hierarchy(sub_labelled: DataFrame, top: int = 15, named_from: float = 0.08) -> DataFrame:
    """Stacked bars of ``top, sub, label, size``: sub-groups below 0 are left out, the largest ``top`` groups are shown."""
    kept = sub_labelled.where("sub >= 0")
    totals = kept.groupBy("top").agg(F.sum("size").alias("total"))
    chosen = totals.orderBy(F.desc("total"), "top").limit(top).withColumn("bar", F.row_number().over(Window.orderBy(F.desc("total"), "top")) - 1)  # top rows
    share = kept.join(F.broadcast(chosen), "top").withColumn("fraction", F.col("size") / F.col("total"))
    left = Window.partitionBy("top").orderBy(F.desc("size"), "sub").rowsBetween(Window.unboundedPreceding, -1)
    return share.select("top", "sub", "bar", "total", "fraction", F.coalesce(F.sum("fraction").over(left), F.lit(0.0)).alias("left"), F.when(F.col("fraction") > named_from, first_label("label")).alias("shown_label"))


def complexity_points(metrics: DataFrame, bars: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("neural_complexity", 9)), "cid"))  # one row a cluster
    return metrics.select("cid", "integration", "differentiation", F.greatest(F.lit(20), 5 * F.col("total_bridge_connections")).alias("marker_size"), "neural_complexity", (rank <= bars).alias("in_bars"))
