"""Groups of linked nodes by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``m``, the smallest of u and all nodes next to it."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def linked(edges: DataFrame) -> DataFrame:
    """Undirected ``edges`` (a, b) of longs to (node, group), the group being its smallest node.

    Nodes without an edge to another are not returned. A round keeps at most one edge for each edge before it, and
    rounds grow with the logarithm of the longest path; each is written to the shared folder.
    """
    now, before = stage_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    # Row count and order-free checksum: equal marks mean the stars no longer change.
    while (mark := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before and mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large)
        joined = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now, before = stage_table(joined.filter("a <> b").distinct()), mark
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("group"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("group"))).distinct()
