"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, materialize


def unfinished(edges: DataFrame) -> bool:
    """Whether some node of edges (u > v) has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    met = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not met.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root): for every node of edges (u, v) the smallest node it reaches.

    Each round is two aggregations and two joins over the edges; a hub's edges
    are reduced before the shuffle and the joins can be split by AQE. Rounds
    stop when the edges are a star forest, after logarithmically many; beyond
    `most` rounds an error is raised, never an unfinished answer.
    Empty input gives an empty result; loops and repeated edges do no harm.
    """
    now = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rounds = 0
    while unfinished(now):
        rounds += 1
        if rounds > most:
            raise RuntimeError(f"components are not found after {most} rounds")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.distinct(), "edges")
        forget(before)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    found._shared_path = now._shared_path
    return found
