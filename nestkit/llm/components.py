"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is an aggregate and a join on the node; Spark can split the join where one node has most of the edges.
Edges, labels and components stay distributed; the driver sees one digest a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """edges (a, b) of longs, in either direction, repeats allowed. Returns (node, root) for each node that has an
    edge to another one; root is the smallest node of its component. Nulls and loops are left out."""
    now = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most):
        # Large star: larger neighbours of a node go to the smallest of its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours of a node, and itself, go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), F.col("m")))).alias("e"))
        old, now = now, scratch.save(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct())
        scratch.drop(old)
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if digest == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = digest
    raise RuntimeError(f"no fixed point after {most} rounds")
