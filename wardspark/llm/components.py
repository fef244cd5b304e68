"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that is not the smallest of its component.

    Every round hooks the larger neighbours of a node, then the smaller ones, to the smallest; the rounds end
    when only stars are left, after a number that grows with the logarithm of the longest chain.  Neighbours are
    reduced to their minimum before the shuffle, so a node with very many of them is no large group.
    """
    star = written(oriented(edges), "edges")
    for _ in range(MOST_ROUNDS):
        if settled(star):
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    raise RuntimeError(f"components not settled after {MOST_ROUNDS} rounds")


def settled(star: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none that has a smaller one itself."""
    ends = star.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        star.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
