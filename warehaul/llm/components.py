"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warehaul.session import materialised


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node's neighbourhood."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").groupBy("u", "v").agg(F.lit(1).alias("_one")).select("u", "v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: two bigint columns ``u`` and ``v``; direction, repeats and loops do not matter, nulls are
    dropped. Returns ``node`` and ``root``, without roots themselves. The number of rounds grows with the
    logarithm of the longest chain; each round is written to the shared folder, which cuts the lineage.
    """
    now = materialised(_distinct(edges.select("u", "v").dropna()), "edges")
    seen = None
    while (state := _state(now)) != seen:
        seen = state
        if state[0] == 0:
            break
        now = materialised(_distinct(_small_star(_distinct(_large_star(now)))), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
