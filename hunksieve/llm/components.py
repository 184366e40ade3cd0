"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def unsettled(pairs: DataFrame) -> int:
    """How many nodes of `pairs` (u, v) have two pairs above themselves, or one and others below."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("root"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("root") == 0))).count()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): root is the smallest node of its component.

    Each round is aggregates and equi-joins on nodes and leaves one written table; it ends when all pairs are those of
    a node and its root. Loops and repeated edges don't matter. No edges give an empty result.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if not unsettled(pairs):
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = cut(small.distinct(), [pairs])
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merge_roots(member: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """`member` (node, root) with the roots joined that `edges` (a, b: nodes) connect; the smaller root stands for both."""
    ends = edges.join(member.select(F.col(node).alias("a"), F.col("root").alias("_a")), "a").join(member.select(F.col(node).alias("b"), F.col("root").alias("_b")), "b")
    roots = connected_components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return cut(member.join(roots, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to"))
