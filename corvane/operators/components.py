"""Connected components of an edge table, by min-label propagation in alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialize


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that it reaches.

    Each round links every larger neighbour of a node to the node's smallest
    neighbour (large star), then every smaller neighbour likewise (small star).
    Edges only ever shrink towards stars around each component's minimum, and
    depth halves, so a round count logarithmic in the diameter is enough. The
    minimum is a partial aggregate, so a node with very many edges sends one
    row from each task. Each round is written to the shared folder. Self loops
    give single components; null ends are ignored.
    """
    raw = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    pairs = materialize(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes, current = pairs.where("a = b").select("a"), pairs.where("a > b")
    for _ in range(rounds):
        if _all_stars(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a > b").unionByName(lowest.select("a", F.col("low").alias("b")))
        current = materialize(small.distinct(), "edges")
    else:
        raise RuntimeError(f"no convergence in {rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = nodes.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return members.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and no neighbour is itself a member of another star."""
    if not edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
