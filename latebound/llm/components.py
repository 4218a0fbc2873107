"""Connected components by alternating large-star and small-star steps.

Each step replaces edges by edges towards the smallest neighbour; the edge set
ends as stars around the smallest node of each component. A step is an
aggregation (partial sums on the map side, so a node with very many links costs
one row per task) and a join; no neighbour list is collected. Every round is
written to the shared folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    n = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = n.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return n.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two columns of node ids of one orderable type. Returns
    ``node, root`` for every node that has an edge to another one; ``root`` is
    the smallest node of its component. Loops, repeated edges, null ends and
    either direction are allowed; no edges give no rows."""
    x, y = edges.columns
    now = edges.filter(F.col(x) != F.col(y)).select(
        F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now = materialize(now, "components")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct())
        seen = state
        now = materialize(_small_star(_large_star(now)), "components")
