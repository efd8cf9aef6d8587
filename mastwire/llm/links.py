"""Connected components of pairs, by stars that shrink round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mastwire.llm.store import saved


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every node. It is saved, so that the join back can split a hot node."""
    return saved(edges.groupBy("u").agg(F.min("v").alias("m")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0x7FFFFFFF))).first())


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node in a pair: root is the smallest node it is connected with.

    Each round links a node's larger neighbours to its smallest one, then does the same with its
    smaller neighbours, until only stars are left; the rounds grow with the logarithm of the
    longest chain. Pairs with a null and pairs of a node with itself link nothing.
    """
    edges = saved(
        pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    state = None
    while (now := _state(edges)) != state:
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = saved(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = _least(large)
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
