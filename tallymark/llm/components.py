"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import durable


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root``: for every node of an edge the smallest node it can reach.

    Large-star hangs every larger neighbour on the smallest one, small-star every smaller one
    [Kiveris et al. 2014]; both are a partial aggregate and an inner join, so a hub is never gathered
    in one task, and the rounds grow with the logarithm of the size. Each round is checkpointed; the
    driver sees two numbers per round. Self-edges and edges with a null are ignored.
    """
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    pairs = durable(pairs)
    before = _digest(pairs)
    while True:
        pairs = durable(_small_star(_large_star(pairs)))
        after = _digest(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _digest(pairs: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))
    return tuple(pairs.agg(F.count("*"), mixed).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = pairs.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
