"""Shared helpers: reading tables, shipping the package, cutting lineage, Arrow mapping."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans import iterate

ROOT = str(Path(__file__).resolve().parents[2])
SLICE_BYTES = 2 << 20  # what a mapping function gets at once, but for a single larger row


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut, in the cluster's shared checkpoint folder.

    A folder of our own is set only where the session names none and all runs on this machine.
    """
    return iterate.cut(df)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in slices of about ``SLICE_BYTES``, after making sure that workers can import the package.

    Spark's batches have a number of rows, not of bytes; Python objects made of a slice have a bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(_sliced(batches))

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]
