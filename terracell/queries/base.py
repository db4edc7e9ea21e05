"""Helpers that keep a query and its SQL in step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def put(name: str, query: Query, sql: str | None = None, digits: int | None = 6) -> None:
    """Registers a query, rounded; its SQL, if any, over the fixtures' common tables."""
    QUERIES[name] = query if digits is None else lambda spark, sf_dir: rounded(query(spark, sf_dir), digits)
    if sql is not None:
        SQL[name] = sql


def cell_sql(body: str) -> str:
    """SQL over the fixture rasters whose rows are row, col, value."""
    return f"with {fixtures.SQL} select row, col, round(({body.partition(' from ')[0]})::double, 6) + 0.0 as value from {body.partition(' from ')[2]}"


def with_sql(body: str, *more: str) -> str:
    """A whole statement after the fixture rasters and further common tables."""
    return "with " + ", ".join([fixtures.SQL, *more]) + " " + body
