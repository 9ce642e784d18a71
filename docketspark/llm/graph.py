"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import cut


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones: then that neighbour is its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of edges(a long, b long); the component is its smallest node.

    Alternates two steps until only stars are left: every node hands its larger neighbours to its smallest
    neighbour, then its smaller ones. Each step is a minimum per node (combined before the shuffle) and an equi-join
    whose skewed side Spark may split, so that a hub's neighbours are never gathered. Each round's edges are
    checkpointed; only whether they are stars reaches the driver. No edges, no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(edges)
    for _ in range(max_rounds):
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
    else:
        raise RuntimeError(f"still no stars after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
