"""Connected components by alternating large and small stars.

Every round is a few grouped minima and equality joins on the edges; nodes and edges never leave the executors. A hot node
is pre-aggregated before its shuffle and its join is split by the adaptive skew rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of edges(a, b); nodes are longs."""
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        # written first: both sides of the joins then come straight from a shuffle, and a hot node's side is split
        least = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        lower = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        if (now := _state(e)) == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
