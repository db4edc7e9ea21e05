"""Rasters, points and tables derived from the driver's tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COLUMNS = 64

#: The same rasters for SQL: e all cells, n with NoData, m and k the same mirrored and shifted by column.
SQL = """
e as (select vec_id::int as row, (unnest(range(len(embedding))))::int as col, unnest(embedding)::double * 8 as value from embeddings),
n as (select row, col, case when abs(value) < 0.2 then null else value end as value from e),
m as (select row, (63 - col)::int as col, value from n),
k as (select row, ((col + 5) % 64)::int as col, value from n),
i as (select row, col, round(value) + 0.0 as value from n),
j as (select row, (63 - col)::int as col, value from i),
z as (select row, col, (label * 4 + col // 16)::double as zone from (select vec_id::int as row, label, (unnest(range(len(embedding))))::int as col from embeddings))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    cells = t.select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return cells.select("row", "col", (F.col("value").cast("double") * 8).alias("value"))


def n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e(spark, sf_dir).withColumn("value", F.when(F.abs("value") >= 0.2, F.col("value")))


def m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n(spark, sf_dir).withColumn("col", (63 - F.col("col")).cast("int"))


def k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n(spark, sf_dir).withColumn("col", ((F.col("col") + 5) % 64).cast("int"))


def i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n(spark, sf_dir).withColumn("value", F.round("value"))


def j(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i(spark, sf_dir).withColumn("col", (63 - F.col("col")).cast("int"))


def z(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    cells = t.select(F.col("vec_id").cast("int").alias("row"), "label", F.posexplode("embedding").alias("col", "value"))
    return cells.select("row", "col", (F.col("label") * 4 + F.floor(F.col("col") / 16)).cast("double").alias("value"))
