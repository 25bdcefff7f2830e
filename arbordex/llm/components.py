"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself move to the least of them. e: a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("least"))
    moved = e.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b")))


def _digest(e: DataFrame) -> tuple:
    """Differs for different sets of links, for all practical purposes: their number and two sums of hashes."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """node and its component (the smallest node that links reach) for each node of links (a, b: long). Nodes without links are left out.

    Links with a null end or between a node and itself count for nothing. Each round is written to the shared folder. A node with
    very many links has them in a join whose large keys Spark may split, and in sums made before the exchange.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    new, before = written(e, "links"), None
    while (now := _digest(new)) != before:
        before = now
        new = written(_small(_large(new)).distinct(), "links")
    stars = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
