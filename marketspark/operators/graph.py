"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.session import stage


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least node around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "_m").alias("_m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return linked.unionByName(least.select("u", F.col("_m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) with the least node of each component as its name.

    Each round shuffles the edge list a fixed number of times and takes minima that
    combine before the shuffle, so a hub node is no bottleneck; long chains shrink
    geometrically. Rounds are cut by a checkpoint, and only one count and one hash
    sum per round reach the driver to tell whether the edges still change.
    """
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node")))
    current = stage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    )
    before = None
    while True:
        # every node other than its component's least one holds one edge to a smaller node
        current = stage(_small_star(_large_star(current).distinct()).where(F.col("u") != F.col("v")).distinct())
        mark = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == before:
            break
        before = mark
    return nodes.distinct().join(
        current.select(F.col("u").alias("node"), F.col("v").alias("_root")), "node", "left"
    ).select("node", F.coalesce("_root", "node").alias("component"))
