"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: each node's (larger, or smaller) neighbours are linked to the least of them and it."""
    both = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # edges go from the larger u to the smaller v; in the small step only smaller neighbours take part
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if small:
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a > b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Are the edges stars: each u on one edge, and no v the u of another?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
    state = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("top").alias("top"))
    return state.where("below > 1 or below + top > 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node on an edge (u, v); the component is its smallest node."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = stored(_star(_star(now, small=False), small=True), "edges")
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
