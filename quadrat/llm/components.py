"""Connected components of an edge table by alternating large and small stars.

Each round is one grouped minimum over the edges, pre-aggregated before the
shuffle; a vertex with very many neighbours is never gathered into one task.
Rounds are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_parts, stored


def _minimum(both: DataFrame) -> DataFrame:
    """Smallest neighbour of every vertex, the vertex itself included."""
    return both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))


def _settled(e: DataFrame) -> bool:
    """Whether the edges are stars: every vertex has one edge to a smaller one, or
    only edges from larger ones."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("v", F.lit(0), F.lit(1)))
    return (ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``edges(u, v)`` (long ids); the
    component is the smallest vertex reachable. Self edges and repeats do no
    harm; an empty table gives an empty result."""
    few = max(1, shuffle_parts(edges.sparkSession) // 4)     # links are small beside the data
    e = stored(edges.where(F.col("u") != F.col("v"))
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(few), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        # Large star: every larger neighbour goes to the smallest neighbour.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = (both.join(_minimum(both), "u").where(F.col("v") > F.col("u"))
               .select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: a vertex and its smaller neighbours go to the smallest.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        e = stored(big.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where(F.col("u") != F.col("v")).distinct().coalesce(few), "edges")
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
            .union(e.select("v", "v").distinct()))
