"""Connected components of a link table by alternating large and small stars.

Every step is a map-side minimum and an equi join; a hub with a third of all links is
a skewed join, which adaptive execution splits. Links never reach the driver, only a
count and a checksum per round do. Rounds are written tables, so a lost executor costs
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``links``; a component is its smallest node.

    Nodes are longs. Loops, repeated links and null ends are ignored; an empty table
    gives an empty one.
    """
    x, y = F.col(left).cast("long"), F.col(right).cast("long")
    edges = materialise(
        links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), x.alias("_x"), y.alias("_y"))
        .filter("_x <> _y").select("a", "b").distinct(), "links")
    seen = _signature(edges)
    while seen[0]:
        # large star: hand neighbours above a node to the smallest of its neighbourhood
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        large = materialise(large, "large_star")
        # small star: do the same among a node's smaller neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").filter("a <> b").distinct(), "small_star")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))
