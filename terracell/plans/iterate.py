"""Iteration: cutting lineage, connected components and pointer doubling."""

from __future__ import annotations

import gc
import math
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut in the session's checkpoint folder, set here only if it has none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets go of what no DataFrame refers to any more: shuffle files and, where the session cleans them, checkpoints.

    The JVM finds them when it collects garbage, which a driver of little work hardly does; asked once in ``TIDY_S`` at most.
    """
    if time.monotonic() - _TIDIED[0] < TIDY_S:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _TIDIED[0] = time.monotonic()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _OWN[0] = _OWN[0] or tempfile.mkdtemp(prefix="terracell-")
    return named.rstrip("/")


_OWN: list[str | None] = [None]
TIDY_S = 4.0  # seconds between two collections
_TIDIED = [0.0]
ROWS = 250_000  # rows of a forest that a task joins at once, about


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b), by alternating stars."""

    def ordered(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(ordered(edges))
    last = mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ordered(now.select(F.col("a").alias("v"), F.col("b").alias("a")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")))
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(ordered(large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below.select("a", "m"))))
        new = mark(now)
        if new == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        last = new


def doubled(nodes: DataFrame, up: dict[str, str] | None = None, down: dict[str, str] | None = None) -> DataFrame:
    """Aggregates over all ancestors or descendants of a forest, in log2(depth) rounds.

    ``nodes`` has id, next (null at a root) and step (the weight of the edge to next), and value columns.
    ``up`` names columns to gather from everything that leads to a node: "sum", "max", "min", or
    "longest" (greatest sum of steps).  ``down`` names columns to total along the way to the root: "sum".
    Adds jump, the root reached (the node itself at a root), and span, the steps to it.

    Round k knows what lies within 2**k steps and where 2**k steps lead to; a round is one
    aggregation and two equi-joins, combined before the shuffle.
    """
    up, down = up or {}, down or {}
    now = cut(nodes.withColumns({"jump": F.col("next"), "span": F.when(F.col("next").isNull(), 0.0).otherwise(F.coalesce("step", F.lit(0.0))), "root": F.coalesce("next", "id")}))
    with _spread(now.sparkSession, now.count()):
        while True:
            now = _round(now, up, down)
            tidy(now.sparkSession)
            if now.where("jump is not null").limit(1).isEmpty():
                return now


@contextmanager
def _spread(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, shuffles have a partition for every ``ROWS`` rows at least, so a task's part has a bound at any size."""
    key = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(key)
    try:
        spark.conf.set(key, str(max(int(usual), math.ceil(rows / ROWS))))
        yield
    finally:
        spark.conf.set(key, usual)


def _round(now: DataFrame, up: dict[str, str], down: dict[str, str]) -> DataFrame:
    how = {"sum": F.sum, "max": F.max, "min": F.min}
    if up:
        sent = now.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(*[F.max(F.col(c) + F.col("span")).alias(f"g_{c}") if k == "longest" else how[k](c).alias(f"g_{c}") for c, k in up.items()])
        now = now.join(sent, "id", "left")
        for c, k in up.items():
            now = now.withColumn(c, F.col(c) + F.coalesce(f"g_{c}", F.lit(0)) if k == "sum" else (F.least if k == "min" else F.greatest)(F.col(c), F.col(f"g_{c}"))).drop(f"g_{c}")
    far = now.select(F.col("id").alias("_far"), F.col("jump").alias("j2"), F.col("span").alias("s2"), F.col("root").alias("r2"), *[F.col(c).alias(f"d_{c}") for c in down])
    # what has arrived meets nothing; by its own id it is spread, as null it would all be in one task
    now = now.join(far, (F.coalesce("jump", "id") == F.col("_far")) & F.col("jump").isNotNull(), "left")
    now = now.withColumns({"span": F.col("span") + F.coalesce("s2", F.lit(0.0)), "root": F.coalesce("r2", "root"), **{c: F.col(c) + F.coalesce(f"d_{c}", F.lit(0)) for c in down}})
    return cut(now.withColumn("jump", F.col("j2")).drop("_far", "j2", "s2", "r2", *[f"d_{c}" for c in down]))
