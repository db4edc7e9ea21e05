"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import iterate
from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; any order, repeats and loops allowed).

    The root is the smallest node that can be reached.  A round joins each edge with the least
    neighbour of its end, an aggregation that is combined before the shuffle, and skewed joins are
    split at run time; edges are checkpointed each round, and only a checksum reaches the driver.
    """
    now = common.cut(_ordered(edges))
    mark = _checksum(now)
    while True:
        now = common.cut(_small_star(_large_star(now)))
        last, mark = mark, _checksum(now)
        iterate.tidy(edges.sparkSession)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node a to the smaller b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node become linked to its least neighbour, or to itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
    return _ordered(edges.select(F.col("a").alias("v"), F.col("b").alias("a")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours become linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.union(least.select("a", F.col("m"))))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
