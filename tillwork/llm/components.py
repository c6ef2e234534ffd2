"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import stage
from tillwork.operators.skew import own_shuffle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger or smaller neighbours.

    A hub that owns a third of the edges is aggregated on the map side; when its edges meet
    that minimum again, adaptive execution may split them, as both sides are shuffled for it.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = edges.join(own_shuffle(least), "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: the smallest node of its component, for every linked node.

    Loops and repeated links do no harm; no links give no rows. The number of rounds grows with the
    logarithm of the longest chain, and each round is written to the shared folder.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        edges = stage(_star(_star(edges, large=True), large=False))
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if unsettled.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
