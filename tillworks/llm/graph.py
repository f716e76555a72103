"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.config import stage_table


def _mark(edges: DataFrame) -> tuple:
    """Row count and order-free checksum: equal marks mean an unchanged edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame) -> DataFrame:
    """For directed pairs (u, v): every v joined with the smallest node seen next to u (or u itself)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """Undirected ``edges`` (a, b) of longs to (node, component), the component being its smallest node.

    Only nodes with an edge are returned. Each round keeps at most one edge for each edge
    before it, so the work follows the edges; rounds grow with the logarithm of the largest
    path. Every round is written to the shared folder, so no lineage builds up. An empty
    edge table gives an empty result; loops and repeated edges do no harm.
    """
    now = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        linked = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stage_table(linked.where("a <> b").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
