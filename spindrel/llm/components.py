"""Connected components of a distributed graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties the larger (``large``) or the smaller neighbours of each node to its least one."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    tied = both.join(least, F.col("u") == F.col("w"))
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)
    return tied.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b: long) can reach.

    Nodes without an edge have no row; nulls and loops are no edges.  Each
    round is written to the shared folder and checked by a count and a sum of
    hashes only; nothing of the graph comes to the driver.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = scratch.write(edges), None
    while True:
        half = scratch.write(_star(edges, large=True))
        new = scratch.write(_star(half, large=False))
        scratch.drop(edges)
        scratch.drop(half)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
