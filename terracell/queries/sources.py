"""Queries that write a table as files, read them again and give what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..plans.iterate import shared_folder
from ..sources import geotiff, grids, las, shapefile, tools
from . import lidar as ql
from . import vector as qv
from .base import cell_sql, put


def _folder(s) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}"


def _grid(kind):
    def run(s, d):
        path = _folder(s)
        grids.write(fx.n(s, d), path, kind, north=100.0, west=7.0, size=0.5, tile=200)
        return grids.merged(grids.read(s, path, kind), grids.headers(s, path, kind), 100.0, 7.0, 0.5)

    return run


for _kind in ("arc", "grass", "surfer"):
    put(f"source_{_kind}_ascii", _grid(_kind), cell_sql("value from n"))


def _tiff(s, d):
    path = _folder(s)
    geotiff.write(fx.n(s, d), path, north=100.0, west=7.0, size=0.5, tile=200)
    return path


put("source_geotiff", lambda s, d: grids.merged(geotiff.read(s, p := _tiff(s, d)), geotiff.headers(s, p), 100.0, 7.0, 0.5), cell_sql("value from n"))
put("print_geo_tiff_tags", lambda s, d: geotiff.tags(s, _tiff(s, d)).where("tag in (256, 258, 259, 339, 42113)").groupBy("tag", "value").agg(F.count("*").alias("n")))


def _converted(s, d):
    first, path = _folder(s), _folder(s)
    grids.write(fx.n(s, d), first, "arc", north=100.0, west=7.0, size=0.5, tile=200)
    tools.convert_raster_format(s, first, path, "arc", "geotiff", 0.5, 128)
    return grids.merged(geotiff.read(s, path), geotiff.headers(s, path), 100.0, 7.0, 0.5)


put("convert_raster_format", _converted, cell_sql("value from n"))


def _shapes(s, d):
    path = _folder(s)
    shapefile.write(qv.polygons(s, d), path, 1000)
    return shapefile.read(s, path)


put("source_shapefile", lambda s, d: _shapes(s, d).select(F.col("attributes")["fid"].cast("long").alias("fid"), F.col("attributes")["nation"].cast("long").alias("nation"), F.size("parts").alias("n_parts"), F.size("points").alias("n_points"), F.expr("aggregate(points, 0D, (n, p) -> n + p.x)").alias("sum_x"), F.expr("aggregate(points, 0D, (n, p) -> n + p.y)").alias("sum_y")), qv.sql("select fid, nation::bigint as nation, np::int as n_parts, nn::int as n_points, round(sx, 6) + 0.0 as sum_x, round(sy, 6) + 0.0 as sum_y from b join (select fid, count(distinct part) as np, count(*) as nn, sum(x) as sx, sum(y) as sy from v group by 1) using (fid)"))


def _points(s, d):
    path = _folder(s)
    las.write(ql.cloud(s, d), path, 0.00001, 100_000)
    return las.read(s, path)


put("source_las", lambda s, d: _points(s, d).select(F.round("gps").cast("long").alias("gps"), "x", "y", "z", "intensity", "class", "source_id", F.col("scan_angle").cast("int").alias("scan_angle")), ql.lsql("select gps::bigint as gps, x, y, round(z, 6) + 0.0 as z, intensity, class, source_id, scan_angle from l"))
