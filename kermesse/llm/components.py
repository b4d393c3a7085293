"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kermesse.llm.common import materialise


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour, or the node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _smallest_neighbour(both).select("u", F.least("u", "low").alias("low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _smallest_neighbour(down)
    tied = down.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.union(low.select("u", F.col("low").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (left, right): the smallest node of its component.

    Alternating large and small stars until no link changes; a chain halves with every round. All
    sums are partial before they are shuffled, so a node with many links is no hot spot. Nodes that
    are their own smallest are left out: a label is missing where it equals the node.
    """
    edges = materialise(
        links.where("left <> right").select(F.col("left").alias("u"), F.col("right").alias("v")).distinct()
    )
    seen = None
    while True:
        edges = materialise(_small_star(_large_star(edges).distinct()).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
