"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges and labels stay distributed; the driver sees one number a round. Each round is written to the shared
folder, which cuts the lineage, and the round before is deleted. Rounds go on until nothing moves, which takes
about the square of the logarithm of the number of nodes. A node with very many neighbours is an aggregate's and a skew-split join's
work, never one collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import materialise


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hang neighbours on the smallest node of a neighbourhood: the larger neighbours (both) or the smaller ones."""
    larger_first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    around = larger_first.union(larger_first.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else larger_first
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    moved = joined.filter(F.col("v") > F.col("u")) if both else joined
    own = least.filter("u != m").select(F.col("u").alias("v"), "m")
    hung = moved.select("v", "m") if both else moved.select("v", "m").union(own)
    return hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (node, root), a row for each node with an edge; the root is the smallest node reachable."""
    now = materialise(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = materialise(_star(_star(now, True), False), "stars", (now,))
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        seen = state
