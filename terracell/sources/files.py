"""Whole files in and out of tables, in parallel."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

ROWS = 65_536


def parsed(spark: SparkSession, path: str, pattern: str, parse: Callable[[str, bytes], Iterator[dict[str, object]]], schema: str) -> DataFrame:
    """What ``parse`` makes of each file's name and content: dictionaries of columns, each of equal lengths."""
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for columns in parse(name.as_py().rsplit("/", 1)[-1], content.as_py()):
                    yield pa.record_batch([pa.array(columns[f.name], f.type, from_pandas=True) for f in arrow], schema=arrow)

    return files.mapInArrow(run, schema)


def store(path: str, content: bytes) -> None:
    """Writes a file where any executor can, at once as a whole."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, place)


def written(df: DataFrame, keys: list[str], path: str, encode: Callable[[pa.Table], dict[str, bytes]]) -> int:
    """Stores the files that ``encode`` makes of each group of rows; their number.

    A group is one file, so whoever forms the groups bounds them.
    """
    ship(df.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        made = encode(table)
        for name, content in made.items():
            store(f"{path.rstrip('/')}/{name}", content)
        return pa.table({"name": pa.array(list(made), pa.string()), "n_bytes": pa.array([len(c) for c in made.values()], pa.int64())})

    return df.groupBy(*keys).applyInArrow(run, "name string, n_bytes long").agg(F.count("name")).first()[0]


def tiles(cells: DataFrame, tile: int) -> DataFrame:
    """Cells with the tile that they are in."""
    return cells.select("row", "col", "value", F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc"))
