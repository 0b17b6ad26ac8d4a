"""Connected components of a graph given by its links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node with a link to another.

    links: columns a and b, longs, in any direction, repeated or not; rows with a null or a = b link nothing.
    links is read twice, so it should be a written table. Each round halves distances; between rounds the links are
    written to the shared folder. No neighbour list is ever gathered: a node's least neighbour is an aggregate, joined
    back to the links, those of the nodes with most links by broadcast."""
    n = links.count()
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct(), n)
    state = _state(edges)
    while state[0]:
        edges = cut(_small_star(_large_star(edges, state[0]), state[0]), state[0])
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = join_spread(both.where("v > u"), least, "u", "n", keys=2 * n)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    met = join_spread(edges, least, "u", "n", keys=n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return met.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
