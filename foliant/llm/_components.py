"""Distributed union-find: connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    Each round does a large star (neighbours above a node point to its smallest
    neighbour) and a small star (neighbours below point to the smallest).  Only
    ``min`` aggregates and equi-joins are used, so a hub with a million links
    costs partial sums, never one list; the number of rounds grows with the
    logarithm of the longest path.  Rounds are settled as Parquet.
    Null ends and self links are ignored; no links give an empty table.
    """
    one = links.where(F.col(a) != F.col(b))
    edges = settle(one.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
