"""Tools that read and write files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import register, tool
from . import geotiff, grids, las

DATA = "Data Tools"
LIDAR = "LiDAR Tools"


def _read(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    return (geotiff.read(spark, path).where("band = 1"), geotiff.headers(spark, path)) if kind == "geotiff" else (grids.read(spark, path, kind), grids.headers(spark, path, kind))


@tool("ConvertRasterFormat", DATA)
def convert_raster_format(spark: SparkSession, path: str, output: str, kind: str = "arc", to: str = "geotiff", size: float = 1.0, tile: int = 1024) -> int:
    """The raster of a folder of arc, grass, surfer or geotiff files, written as another kind; the number of files."""
    cells, heads = _read(spark, path, kind)
    north, west = heads.selectExpr("max(north)", "min(west)").first()
    if north is None:
        return 0
    one = grids.merged(cells, heads, north, west, size)
    return geotiff.write(one, output, north, west, size, tile) if to == "geotiff" else grids.write(one, output, to, north, west, size, tile)


register("PrintGeoTiffTags", DATA, geotiff.tags)


@tool("AsciiToLas", LIDAR)
def ascii_to_las(spark: SparkSession, path: str, pattern: str, output: str, scale: float = 0.001) -> int:
    """LAS files of the points of ASCII files whose columns a pattern names: x, y, z, i, c, rn, nr, time, sa, r, g, b."""
    from pyspark.sql import functions as F

    from ..operators.lidar import ascii_points

    points = ascii_points(spark, path, pattern)
    # numbers with gaps between partitions: a file holds one partition's block of them
    return las.write(points.withColumn("pid", F.monotonically_increasing_id()), output, scale)


@tool("LasToAscii", LIDAR)
def las_to_ascii(spark: SparkSession, path: str, output: str) -> None:
    """The points of LAS files as text, a row a point."""
    las.read(spark, path).drop("file").write.csv(output, sep=" ", header=True, mode="overwrite")


@tool("LasToZlidar", LIDAR)
def las_to_columns(spark: SparkSession, path: str, output: str, compress: str = "zstd") -> None:
    """The points of LAS files in compressed columnar files."""
    las.read(spark, path).write.parquet(output, compression=compress, mode="overwrite")


@tool("ZlidarToLas", LIDAR)
def columns_to_las(spark: SparkSession, path: str, output: str, scale: float = 0.001) -> int:
    """LAS files of the points of columnar files."""
    return las.write(spark.read.parquet(path), output, scale)
