"""Queries of point clouds: lineitem rows as points, with SQL over the same points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import lidar as li
from . import vector as qv
from .base import put, with_sql

_L = """l as (select l_orderkey * 8 + l_linenumber as pid, (l_partkey % 197) * 0.5::double as x, (l_orderkey % 211) * 0.5::double as y, l_extendedprice / 1000 as z, (l_orderkey % 255)::int as intensity,
  l_linenumber as ret, (1 + greatest(l_linenumber, l_orderkey % 7 + 1) - 1)::int as n_ret, (1 + l_orderkey % 7)::int as class, (l_quantity - 25)::int as scan_angle, (l_suppkey % 4)::int as source_id, l_orderkey::double as gps, l_returnflag as file from (select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice, l_partkey, l_suppkey, l_quantity, l_returnflag) = 1)),
s as (select * from l)"""


def cloud(spark, sf_dir):
    """One point an order and line number, of which the table has some twice."""
    rest = ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    t = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return t.select(
        (o * 8 + n).alias("pid"), (F.col("l_partkey") % 197 * 0.5).alias("x"), (o % 211 * 0.5).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), (o % 255).cast("int").alias("intensity"),
        n.alias("ret"), F.greatest(n, o % 7 + 1).cast("int").alias("n_ret"), (1 + o % 7).cast("int").alias("class"), (F.col("l_quantity") - 25).cast("int").alias("scan_angle"), (F.col("l_suppkey") % 4).cast("int").alias("source_id"), o.cast("double").alias("gps"), F.col("l_returnflag").alias("file"),
    )


def lsql(body: str, *more: str) -> str:
    return with_sql(body, _L, *more)


_C = "c as (select *, floor(-y / 10)::int as row, floor(x / 10)::int as col from l)"
_NEAR = "near as (select a.pid, a.z, b.pid as o, b.z as oz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as dist from s a join s b on b.x between a.x - 1.0 and a.x + 1.0 and b.y between a.y - 1.0 and a.y + 1.0 where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.0)"
put("filter_lidar_classes", lambda s, d: li.filter_lidar_classes(cloud(s, d), "3-5,7").select("pid", "class"), lsql("select pid, class from l where class not in (3, 4, 5, 7)"))
put("filter_lidar_scan_angles", lambda s, d: li.filter_lidar_scan_angles(cloud(s, d), 10).select("pid", "scan_angle"), lsql("select pid, scan_angle from l where abs(scan_angle) <= 10"))
put("find_flightline_edge_points", lambda s, d: li.find_flightline_edge_points(cloud(s, d).withColumn("edge", F.col("scan_angle") == 20)).select("pid"), lsql("select pid from l where scan_angle = 20"))
put("lidar_elevation_slice", lambda s, d: li.lidar_elevation_slice(cloud(s, d), 20.0, 40.0).select("pid", "z"), lsql("select pid, round(z, 6) + 0.0 as z from l where z between 20 and 40"))
put("lidar_elevation_slice_classes", lambda s, d: li.lidar_elevation_slice(cloud(s, d), 20.0, 40.0, True).select("pid", "class"), lsql("select pid, case when z between 20 and 40 then 2 else 1 end::int as class from l"))
put("lidar_remove_duplicates", lambda s, d: li.lidar_remove_duplicates(cloud(s, d)).select("pid"), lsql("select pid from (select pid, count(*) over (partition by x, y) as n from l) where n = 1"))
put("lidar_join", lambda s, d: li.lidar_join([cloud(s, d).where("ret = 1"), cloud(s, d).where("ret = 2")]).select("pid", "ret"), lsql("select pid, ret from l where ret in (1, 2)"))
_IN = "pip as (select p.pid, m.fid from l p join b m on p.x between m.x0 and m.x0 + m.w + m.s and p.y between m.y0 and m.y0 + m.h where p.y < m.y0 + m.h and p.x - m.x0 < m.w + m.s * (1 - (p.y - m.y0) / m.h) and not (m.fid % 3 = 0 and p.x - m.x0 >= m.w / 4 and p.x - m.x0 < m.w / 2 and p.y - m.y0 >= m.h / 4 and p.y - m.y0 < m.h / 2))"
put("clip_lidar_to_polygon", lambda s, d: li.clip_lidar_to_polygon(cloud(s, d), qv.polygons(s, d)).select("pid"), lsql("select distinct pid from pip", qv._BASE, _IN))
put("erase_polygon_from_lidar", lambda s, d: li.erase_polygon_from_lidar(cloud(s, d), qv.polygons(s, d)).select("pid"), lsql("select pid from l where pid not in (select pid from pip)", qv._BASE, _IN))
put("classify_buildings_in_lidar", lambda s, d: li.classify_buildings_in_lidar(cloud(s, d), qv.polygons(s, d)).select("pid", "class"), lsql("select pid, case when pid in (select pid from pip) then 6 else class end::int as class from l", qv._BASE, _IN))
put("select_tiles_by_polygon", lambda s, d: li.select_tiles_by_polygon(cloud(s, d), qv.polygons(s, d)), lsql("select distinct file from l where pid in (select pid from pip)", qv._BASE, _IN))
_OVER = "ov as (select *, min(source_id) over w as lo, max(source_id) over w as hi, first_value(source_id) over (partition by row, col order by abs(scan_angle), source_id) as flat, first_value(source_id) over (partition by row, col order by gps, source_id) as early from c window w as (partition by row, col))"
for _name, _rule in {"max scan angle": "source_id <> flat", "not min point source ID": "source_id <> lo", "not min time": "source_id <> early", "multiple point source IDs": "true"}.items():
    put("classify_overlap_" + _name.replace(" ", "_").lower(), (lambda n: lambda s, d: li.classify_overlap_points(cloud(s, d), 10.0, n).select("pid", "class"))(_name), lsql(f"select pid, case when lo < hi and {_rule} then 12 else class end::int as class from ov", _C, _OVER))
put("lidar_classify_subset", lambda s, d: li.lidar_classify_subset(cloud(s, d), cloud(s, d).where("ret = 1"), 9, 1).select("pid", "class"), lsql("select pid, case when exists (select 1 from l b where b.ret = 1 and b.x = l.x and b.y = l.y and round(b.z, 3) = round(l.z, 3)) then 9 else 1 end::int as class from l"))
put("lidar_shift", lambda s, d: li.lidar_shift(cloud(s, d), 1.0, -2.0, 0.5).select("pid", "x", "y", "z"), lsql("select pid, x + 1 as x, y - 2 as y, round(z + 0.5, 6) as z from l"))
put("lidar_colourize", lambda s, d: li.lidar_colourize(cloud(s, d), fx.e(s, d).withColumn("value", F.floor(F.abs("value") * 1e6).cast("double")), north=106.0, resolution=2.0).select("pid", "red", "green", "blue"), lsql("select pid, (v & 255)::int as red, ((v >> 8) & 255)::int as green, ((v >> 16) & 255)::int as blue from l left join (select row, col, floor(abs(value) * 1e6)::bigint as v from e) i on i.row = floor((106 - y) / 2) and i.col = floor(x / 2)"))
for _method, _order in {"first": "pid", "last": "pid desc", "lowest": "z, pid", "highest": "z desc, pid", "nearest": "(x - (col + 0.5) * 10) ** 2 + (y + (row + 0.5) * 10) ** 2, pid"}.items():
    put(f"lidar_thin_{_method}", (lambda m: lambda s, d: li.lidar_thin(cloud(s, d), 10.0, m).select("pid"))(_method), lsql(f"select pid from (select pid, row_number() over (partition by row, col order by {_order}) as k from c) where k = 1", _C))
put("lidar_thin_high_density", lambda s, d: li.lidar_thin_high_density(cloud(s, d), 10.0, 0.5).select("pid"), lsql("select pid from (select *, row_number() over (partition by row, col, bin order by pid) - 1 as k, count(*) over (partition by row, col, bin) as m from (select *, floor((z - min(z) over (partition by row, col)) / 10) as bin, count(*) over (partition by row, col) as n from c)) where not (n > 50 and m > 50 and k % (floor(m / 50.0) + 1) < floor(m / 50.0))", _C))
put("lidar_tile", lambda s, d: li.lidar_tile(cloud(s, d), 7.0, 9.0, 1.0, 2.0, 40).select("pid", "tile_x", "tile_y"), lsql("select pid, tile_x, tile_y from (select *, count(*) over (partition by tile_x, tile_y) as n from (select pid, floor((x - 1) / 7)::bigint as tile_x, floor((y - 2) / 9)::bigint as tile_y from l)) where n >= 40"))
put("lidar_block_maximum", lambda s, d: li.lidar_block_maximum(cloud(s, d), 10.0), lsql("select row, col, round(max(z), 6) + 0.0 as value from c group by 1, 2", _C))
put("lidar_block_minimum", lambda s, d: li.lidar_block_minimum(cloud(s, d), 10.0), lsql("select row, col, round(min(z), 6) + 0.0 as value from c group by 1, 2", _C))
put("flightline_overlap", lambda s, d: li.flightline_overlap(cloud(s, d), 10.0), lsql("select row, col, count(distinct source_id)::double as value from c group by 1, 2", _C))
put("lidar_point_stats", lambda s, d: li.lidar_point_stats(cloud(s, d), 10.0), lsql("select row, col, num_points, num_pulses, round(num_points / nullif(num_pulses, 0), 6) as avg_points_per_pulse, z_range, intensity_range, predom_class from (select row, col, count(*) as num_points, count(*) filter (ret = 1) as num_pulses, round(max(z) - min(z), 6) as z_range, (max(intensity) - min(intensity))::double as intensity_range from c group by 1, 2) join (select row, col, class as predom_class from (select row, col, class, row_number() over (partition by row, col order by count(*) desc, class) as k from c group by 1, 2, 3) where k = 1) using (row, col)", _C))
_G = "g as (select row, col, (col + 0.5)::double as x, (106 - (row + 0.5))::double as y from n), u as (select x, y, z, pid from l where ret = 1 and z <= 60), gn as (select g.row, g.col, u.x as ux, u.y as uy, u.z, sqrt((u.x - g.x) ** 2 + (u.y - g.y) ** 2) as dist from g join u on u.x between g.x - 1.2 and g.x + 1.2 and u.y between g.y - 1.2 and g.y + 1.2 where sqrt((u.x - g.x) ** 2 + (u.y - g.y) ** 2) <= 1.2)"


put("lidar_point_density", lambda s, d: li.lidar_point_density(cloud(s, d), fx.n(s, d), 1.2, north=106.0, returns="first", maxz=60.0), lsql("select g.row, g.col, round(coalesce(n, 0) / (pi() * 1.44), 6) + 0.0 as value from g left join (select row, col, count(*) as n from gn group by 1, 2) x on x.row = g.row and x.col = g.col", _G))
put("lidar_idw_interpolation", lambda s, d: li.lidar_idw_interpolation(cloud(s, d), fx.n(s, d), radius=1.2, north=106.0, returns="first", maxz=60.0), lsql("select g.row, g.col, round(v, 6) + 0.0 as value from g left join (select row, col, coalesce(avg(z) filter (dist = 0), sum(z / dist) filter (dist > 0) / sum(1 / dist) filter (dist > 0)) as v from gn group by 1, 2) x on x.row = g.row and x.col = g.col", _G))
put("lidar_nearest_neighbour_gridding", lambda s, d: li.lidar_nearest_neighbour_gridding(cloud(s, d), fx.n(s, d), radius=1.2, north=106.0, returns="first", maxz=60.0), lsql("select g.row, g.col, round(z, 6) + 0.0 as value from g left join (select *, row_number() over (partition by row, col order by dist, ux, uy, z) as k from gn) x on x.row = g.row and x.col = g.col and k = 1", _G))
put("lidar_digital_surface_model", lambda s, d: li.dsm(li.selected(cloud(s, d), "first", maxz=60.0), fx.n(s, d), 1.2, north=106.0), lsql("select g.row, g.col, round(v, 6) + 0.0 as value from g left join (select row, col, max(z) as v from gn group by 1, 2) x on x.row = g.row and x.col = g.col", _G))
put("lidar_hex_binning", lambda s, d: li.lidar_hex_binning(cloud(s, d), 7.3))
put("lidar_remove_outliers", lambda s, d: li.lidar_remove_outliers(cloud(s, d).withColumn("class", F.lit(1)), 1.0, 25.0).select("pid", "class"), lsql("select s.pid, case when s.z - m >= 25 then 18 when s.z - m <= -25 then 7 else 1 end::int as class from s left join (select pid, avg(oz) as m from near where o <> pid group by 1) x on x.pid = s.pid", _NEAR))
put("lidar_tophat_transform", lambda s, d: li.lidar_tophat_transform(cloud(s, d), 1.0).select("pid", "z"), lsql("select n.pid, round(any_value(n.z) - max(x.low), 6) + 0.0 as z from near n join (select pid, min(oz) as low from near group by 1) x on x.pid = n.o group by 1", _NEAR))
_GROUND = "gp as (select x, y, min(pid) as pid, arg_min(z, pid) as z from l where class = 2 group by 1, 2), lp as (select distinct x, y from l where class <> 2), ng as (select lp.x, lp.y, arg_min(gp.z, {'d': sqrt((lp.x - gp.x) ** 2 + (lp.y - gp.y) ** 2), 'p': gp.pid}) as oz from lp cross join gp group by 1, 2)"
put("height_above_ground", lambda s, d: li.height_above_ground(cloud(s, d)).select("pid", "z"), lsql("select l.pid, round(case when l.class = 2 then 0 else l.z - ng.oz end, 6) + 0.0 as z from l left join ng on ng.x = l.x and ng.y = l.y", _GROUND))
put("normalize_lidar", lambda s, d: li.normalize_lidar(cloud(s, d), fx.n(s, d), 2.0, 106.0).select("pid", "z"), lsql("select pid, round(z - n.value, 6) + 0.0 as z from l join n on n.row = floor((106 - y) / 2) and n.col = floor(x / 2) and n.value is not null"))
#: Last returns by place, those within 1.0, their opening, and for places of fewer than 2 points all up to the second.
_OPEN = (
    "gu as (select * from l where class not in (7, 18)), pl as materialized (select x, y, min(z) as low, count(*) as n from gu where ret = n_ret group by 1, 2)",
    "nb as materialized (select a.x, a.y, b.x as px, b.y as py, b.low, b.n, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as dist from pl a join pl b on b.x between a.x - 1.0 and a.x + 1.0 and b.y between a.y - 1.0 and a.y + 1.0 where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.0)",
    "er as (select x, y, min(low) as e from nb group by 1, 2), op as materialized (select nb.x, nb.y, max(er.e) as base from nb join er on er.x = nb.px and er.y = nb.py group by 1, 2)",
    "few as materialized (select x, y from nb group by 1, 2 having sum(n) < 2), far as materialized (select *, sum(n) over (partition by x, y order by dist) as upto from (select f.x, f.y, b.x as px, b.y as py, b.n, sqrt((f.x - b.x) ** 2 + (f.y - b.y) ** 2) as dist from few f cross join pl b))",
    "reach as (select x, y, coalesce(min(dist) filter (upto >= 2), max(dist)) as r from far group by 1, 2)",
    "met as (select nb.x, nb.y, px, py, dist from nb anti join few on few.x = nb.x and few.y = nb.y union all select far.x, far.y, px, py, dist from far join reach on reach.x = far.x and reach.y = far.y and dist <= r)",
    f"top as (select met.x, met.y, min(pl.low - op.base + dist * {math.tan(math.radians(45.0))!r}) as t from met join pl on pl.x = px and pl.y = py join op on op.x = px and op.y = py where dist > 0 group by 1, 2)",
)
put("lidar_ground_point_filter", lambda s, d: li.lidar_ground_point_filter(cloud(s, d), 1.0, 2).select("pid", "class"), lsql("select gu.pid, case when ret <> n_ret or z - base >= 1 or coalesce(z - base > t, false) then 1 else 2 end::int as class from gu left join op on op.x = gu.x and op.y = gu.y left join top on top.x = gu.x and top.y = gu.y", *_OPEN))
put("normal_vectors", lambda s, d: li.normal_vectors(cloud(s, d), 1.0).select("pid", "red", "green", "blue"))
put("lidar_hillshade", lambda s, d: li.lidar_hillshade(cloud(s, d), radius=1.0).select("pid", "shade"))
put("lidar_info", lambda s, d: li.lidar_info(cloud(s, d)), lsql("select file, count(*) as n, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, round(min(z), 6) as min_z, round(max(z), 6) as max_z, round(count(*) / ((max(x) - min(x)) * (max(y) - min(y))), 6) as density from l group by 1"))
put("lidar_info_classes", lambda s, d: li.lidar_info_classes(cloud(s, d)), lsql("select file, class, ret, count(*) as n from l group by 1, 2, 3"))
put("lidar_histogram", lambda s, d: li.lidar_histogram(cloud(s, d), "elevation", 2.0, 20), lsql("select least(floor((z - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n from l cross join (select quantile_cont(z, 0.02) as lo, quantile_cont(z, 0.98) as hi from l) where z between lo and hi group by 1"))
put("lidar_kappa_index", lambda s, d: li.lidar_kappa_index(cloud(s, d), li.lidar_elevation_slice(cloud(s, d), 20.0, 40.0, True)), lsql("select class as class1, case when z between 20 and 40 then 2 else 1 end::int as class2, count(*) as n from l group by 1, 2"))
put("las_to_multipoint_shapefile", lambda s, d: li.las_to_multipoint_shapefile(cloud(s, d)).select("file", "block", F.size("points").alias("n")), lsql("select file, (pid // 100000)::bigint as block, count(*)::int as n from l group by 1, 2"))
put("las_to_shapefile", lambda s, d: li.las_to_shapefile(cloud(s, d)).select("fid", F.col("points")[0]["x"].alias("x"), "z"), lsql("select pid as fid, x, round(z, 6) + 0.0 as z from l"))
put("lidar_tile_footprint", lambda s, d: qv.ve.lidar_tile_footprint(cloud(s, d)).select("file", qv.ve.area().alias("area")), lsql("select file, (max(x) - min(x)) * (max(y) - min(y)) + 0.0 as area from l group by 1"))
put("lidar_tile_footprint_hull", lambda s, d: qv.ve.lidar_tile_footprint(cloud(s, d), True).select("file", qv.ve.area().alias("area")))
