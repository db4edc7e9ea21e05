"""Queries of vector features, with SQL over the same features unnested to vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import vector as ve
from .base import put, with_sql

_RING = [("0", "0"), ("0", "h"), ("w", "h"), ("w + s", "0"), ("0", "0")]
_HOLE = [("w / 4", "h / 4"), ("w / 2", "h / 4"), ("w / 2", "h / 2"), ("w / 4", "h / 2"), ("w / 4", "h / 4")]
#: A trapezium a customer, every third with a square hole; v has a row a vertex.
_BASE = "b as (select c_custkey as fid, c_nationkey as nation, (c_custkey % 40) * 10.0::double as x0, (c_custkey // 40) * 10.0::double as y0, 1.0::double + c_custkey % 7 as w, 1.0::double + c_custkey % 5 as h, (c_custkey % 3)::double as s from customer)"
_V = "v as (" + " union all ".join(f"select fid, nation, {part} as part, {k} as k, x0 + {x} as x, y0 + {y} as y from b" + (" where fid % 3 = 0" if part else "") for part, ring in enumerate((_RING, _HOLE)) for k, (x, y) in enumerate(ring)) + ")"
_E = "e2 as (select fid, part, k, x, y, lead(x) over w as x2, lead(y) over w as y2 from v window w as (partition by fid, part order by k))"
_R = "r as (select fid, part, sum(x * y2 - x2 * y) / 2 as a, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) as len from e2 where x2 is not null group by 1, 2)"
_M = "mm as (select fid, sum(len) as len, sum(abs(a)) filter (part = 0) as hull, coalesce(sum(abs(a)) filter (part = 1), 0) as hole from r group by 1)"


def sql(body: str) -> str:
    return "with " + ", ".join([_BASE, _V, _E, _R, _M]) + " " + body


def polygons(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    own = c.select(k.alias("fid"), F.col("c_nationkey").alias("nation"), (k % 40 * 10.0).alias("x0"), (F.floor(k / 40) * 10.0).alias("y0"), (1.0 + k % 7).alias("w"), (1.0 + k % 5).alias("h"), (k % 3).cast("double").alias("s"))
    ring = lambda rows: F.array(*[F.struct(F.expr(f"x0 + {x}").cast("double").alias("x"), F.expr(f"y0 + {y}").cast("double").alias("y")) for x, y in rows])
    holed = F.col("fid") % 3 == 0
    return own.select("fid", F.lit(ve.POLYGON).alias("shape_type"), F.when(holed, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0))).alias("parts"), F.when(holed, F.concat(ring(_RING), ring(_HOLE))).otherwise(ring(_RING)).alias("points"), "nation")


def points(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("fid"), (F.col("event_id") % 97 * 0.625).cast("double").alias("x"), (F.col("user_id") % 83 * 0.75).cast("double").alias("y"), F.round("value", 4).alias("z"))


_P = "p as (select event_id as fid, (event_id % 97 * 0.625)::double as x, (user_id % 83 * 0.75)::double as y, round(value, 4) as z from events)"


def psql(body: str, *more: str) -> str:
    return with_sql(body, _P, *more)


for _name, (_column, _how, _) in ve._MEASURES.items():
    _text = {"AREA": "hull - hole", "PERIMETER": "len", "P_A_RATIO": "len / (hull - hole)", "COMPACT": "(hull - hole) / len", "HOLE_PROP": "hole / hull"}[_column]
    put(f"vector_{_name}", (lambda c, h: lambda s, d: polygons(s, d).select("fid", h().alias(c)))(_column, _how), sql(f"select fid, round({_text}, 6) + 0.0 as {_column} from mm"))
put("linearity_index", lambda s, d: ve.linearity_index(polygons(s, d)).select("fid", "LINEARITY"), sql("select fid, round(coalesce(regr_r2(y, x), 0), 6) + 0.0 as LINEARITY from v where part = 0 group by 1"))
put("patch_orientation", lambda s, d: ve.patch_orientation(polygons(s, d)).select("fid", "ORIENT"), sql("select fid, round(90 - degrees(atan(sqrt(var_pop(y) / var_pop(x)) * case when round(covar_pop(y, x), 9) < 0 then -1 else 1 end)), 6) + 0.0 as ORIENT from v where part = 0 group by 1"))
put("minimum_convex_hull", lambda s, d: ve.minimum_convex_hull(polygons(s, d)).select("fid", ve.area().alias("area"), F.size("points").alias("corners")), sql("select fid, round(hull, 6) + 0.0 as area, 5::int as corners from mm"))
put("minimum_convex_hull_layer", lambda s, d: ve.minimum_convex_hull(polygons(s, d), per=False).select("fid", ve.area().alias("area")))
put("minimum_bounding_box", lambda s, d: ve.minimum_bounding_box(polygons(s, d)).select("fid", "short_axis", "long_axis", ve.area().alias("area")))
put("minimum_bounding_circle", lambda s, d: ve.minimum_bounding_circle(polygons(s, d)).select("fid", "x", "y", "radius"))
_BOX = "select fid, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from v group by fid"
put("minimum_bounding_envelope", lambda s, d: ve.minimum_bounding_envelope(polygons(s, d)).select("fid", ve.area().alias("area"), ve.perimeter().alias("perimeter")), sql(f"select fid, (x1 - x0) * (y1 - y0) + 0.0 as area, 2 * (x1 - x0 + y1 - y0) + 0.0 as perimeter from ({_BOX})"))
put("layer_footprint", lambda s, d: ve.layer_footprint(polygons(s, d)).select(ve.area().alias("area")), sql("select (max(x) - min(x)) * (max(y) - min(y)) + 0.0 as area from v"))
put("shape_complexity_index", lambda s, d: ve.shape_complexity_index(polygons(s, d)).select("fid", "COMPLEXITY"), sql("select fid, round(1 - (hull - hole) / hull, 6) + 0.0 as COMPLEXITY from mm"))
put("related_circumscribing_circle", lambda s, d: ve.related_circumscribing_circle(polygons(s, d)).select("fid", "RC_CIRCLE"))
put("elongation_ratio", lambda s, d: ve.elongation_ratio(polygons(s, d)).select("fid", "ELONGATION"))
put("polygon_long_axis", lambda s, d: ve.polygon_long_axis(polygons(s, d)).select("fid", ve.perimeter().alias("length")))
put("polygon_short_axis", lambda s, d: ve.polygon_short_axis(polygons(s, d)).select("fid", ve.perimeter().alias("length")))
put("deviation_from_regional_direction", lambda s, d: ve.deviation_from_regional_direction(polygons(s, d), 0.3).select("fid", "DEV_DIR"))
put("add_point_coordinates", lambda s, d: ve.add_point_coordinates(polygons(s, d)).select("fid", "XCOORD", "YCOORD"), sql("select fid, x0 as XCOORD, y0 as YCOORD from b"))
put("clean_vector", lambda s, d: ve.clean_vector(polygons(s, d)).select("fid", F.size("points").alias("n")), sql("select fid, count(*)::int as n from v group by 1"))
put("lines_to_polygons", lambda s, d: ve.lines_to_polygons(ve.polygons_to_lines(polygons(s, d)).withColumn("points", F.reverse("points")).where("size(parts) = 1")).select("fid", ve.area().alias("area"), ve.signed_area(F.get(ve.rings(), F.lit(0))).alias("signed")), sql("select fid, round(hull, 6) + 0.0 as area, round(-hull, 6) + 0.0 as signed from mm where fid % 3 <> 0"))
put("polygons_to_lines", lambda s, d: ve.polygons_to_lines(polygons(s, d)).select("fid", "shape_type", ve.perimeter().alias("length")), sql("select fid, 3::int as shape_type, round(len, 6) + 0.0 as length from mm"))
put("remove_polygon_holes", lambda s, d: ve.remove_polygon_holes(polygons(s, d)).select("fid", ve.area().alias("area"), F.size("parts").alias("parts")), sql("select fid, round(hull, 6) + 0.0 as area, 1::int as parts from mm"))
put("multipart_to_singlepart", lambda s, d: ve.multipart_to_singlepart(polygons(s, d)).select("fid", "part", ve.perimeter().alias("length"), "nation"), sql("select fid, part, round(len, 6) + 0.0 as length, c_nationkey as nation from r join customer on c_custkey = fid"))
put("singlepart_to_multipart", lambda s, d: ve.singlepart_to_multipart(polygons(s, d), "nation").select("nation", "fid", F.size("parts").alias("n_parts"), ve.perimeter().alias("length")), sql("select c_nationkey as nation, min(fid) as fid, count(*)::int as n_parts, round(sum(len), 6) + 0.0 as length from r join customer on c_custkey = fid group by 1"))
put("merge_vectors", lambda s, d: ve.merge_vectors({"a": polygons(s, d), "b": polygons(s, d).where("fid % 2 = 0")}).select("fid", "PARENT", "nation"), sql("select fid, 'a' as PARENT, nation from b union all select fid, 'b', nation from b where fid % 2 = 0"))
put("reinitialize_attribute_table", lambda s, d: ve.reinitialize_attribute_table(polygons(s, d)).select("fid", F.size("points").alias("n")), sql("select fid, count(*)::int as n from v group by 1"))
put("join_tables", lambda s, d: ve.join_tables(polygons(s, d).select("fid", "nation"), "fid", fx.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", order="o_orderkey"), "select c_custkey as fid, c_nationkey as nation, o_orderkey, round(o_totalprice, 6) + 0.0 as o_totalprice from customer left join (select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1) on o_custkey = c_custkey")
put("extract_by_attribute", lambda s, d: ve.extract_by_attribute(polygons(s, d), "nation > 10 and fid % 2 = 1").select("fid", "nation"), sql("select fid, nation from b where nation > 10 and fid % 2 = 1"))
put("extract_nodes", lambda s, d: ve.extract_nodes(polygons(s, d)), sql("select fid, (part * 5 + k)::int as node, x, y from v"))
put("centroid_vector", lambda s, d: ve.centroid_vector(polygons(s, d)), sql("select fid, round(avg(x), 6) + 0.0 as x, round(avg(y), 6) + 0.0 as y from v group by 1"))
put("medoid", lambda s, d: ve.medoid(polygons(s, d)))
put("smooth_vectors", lambda s, d: ve.smooth_vectors(ve.polygons_to_lines(polygons(s, d)), 3), sql("select fid, part, k, round(case when k in (0, 4) then x else avg(x) over w end, 6) + 0.0 as x, round(case when k in (0, 4) then y else avg(y) over w end, 6) + 0.0 as y from v window w as (partition by fid, part order by k rows between 1 preceding and 1 following)"))
put("eliminate_coincident_points", lambda s, d: ve.eliminate_coincident_points(points(s, d), 0.8).select("fid"), psql("select fid from p where not exists (select 1 from p q where q.fid < p.fid and q.x between p.x - 0.8 and p.x + 0.8 and q.y between p.y - 0.8 and p.y + 0.8 and sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) <= 0.8)"))
_PIP = "pip as (select p.row, p.col, m.fid from (select row, col, col + 0.5 as x, row + 0.5 as y from n) p join b m on p.x between m.x0 and m.x0 + m.w + m.s and p.y between m.y0 and m.y0 + m.h where p.y < m.y0 + m.h and p.x - m.x0 < m.w + m.s * (1 - (p.y - m.y0) / m.h) and not (m.fid % 3 = 0 and p.x - m.x0 >= m.w / 4 and p.x - m.x0 < m.w / 2 and p.y - m.y0 >= m.h / 4 and p.y - m.y0 < m.h / 2))"


def _south(cells):
    """The polygons lie north of the origin, so rows are counted upwards here."""
    return cells.withColumn("row", -F.col("row") - 1)


def _north(cells):
    return cells.withColumn("row", (-F.col("row") - 1).cast("int"))


put("clip_raster_to_polygon", lambda s, d: _north(ve.clip_raster_to_polygon(_south(fx.n(s, d)), polygons(s, d))), with_sql("select n.row, n.col, round(case when x.row is not null then n.value end, 6) + 0.0 as value from n left join (select distinct row, col from pip) x on x.row = n.row and x.col = n.col", _BASE, _PIP))
put("erase_polygon_from_raster", lambda s, d: _north(ve.erase_polygon_from_raster(_south(fx.n(s, d)), polygons(s, d))), with_sql("select n.row, n.col, round(case when x.row is null then n.value end, 6) + 0.0 as value from n left join (select distinct row, col from pip) x on x.row = n.row and x.col = n.col", _BASE, _PIP))
put("vector_polygons_to_raster", lambda s, d: _north(ve.vector_polygons_to_raster(polygons(s, d), _south(fx.n(s, d)), "nation")), with_sql("select n.row, n.col, v::double as value from n left join (select row, col, arg_max(b.nation, b.fid) as v from pip join b using (fid) group by 1, 2) x on x.row = n.row and x.col = n.col", _BASE, _PIP))
put("raster_to_vector_points", lambda s, d: ve.raster_to_vector_points(fx.i(s, d), 0.0, 5.0, 2.0), with_sql("select row::bigint * 4294967296 + col as fid, 5 + (col + 0.5) * 2.0::double as x, 0 - (row + 0.5) * 2.0::double as y, value as VALUE from i where value <> 0"))
_AT = "q as (select *, floor(-y / 5)::int as row, floor(x / 5)::int as col from p)"
for _assign, _how in {"first": "arg_min(z, fid)", "last": "arg_max(z, fid)", "min": "min(z)", "max": "max(z)", "sum": "sum(z)", "number": "count(*)::double"}.items():
    put(f"vector_points_to_raster_{_assign}", (lambda a: lambda s, d: ve.vector_points_to_raster(points(s, d), "z", a, resolution=5.0))(_assign), psql(f"select row, col, round({_how}, 6) + 0.0 as value from q group by 1, 2", _AT))
put("block_maximum_gridding", lambda s, d: ve.block_maximum_gridding(points(s, d), "z", resolution=5.0), psql("select row, col, max(z) + 0.0 as value from q group by 1, 2", _AT))
put("block_minimum_gridding", lambda s, d: ve.block_minimum_gridding(points(s, d), "z", resolution=5.0), psql("select row, col, min(z) + 0.0 as value from q group by 1, 2", _AT))
_GRID = "g as (select row, col, (col + 0.5)::double as x, (64 - (row + 0.5))::double as y from n), u as (select x, y, avg(z) as z from p group by 1, 2), near as (select g.row, g.col, u.x as ux, u.y as uy, u.z, sqrt((u.x - g.x) ** 2 + (u.y - g.y) ** 2) as dist from g join u on u.x between g.x - 1.5 and g.x + 1.5 and u.y between g.y - 1.5 and g.y + 1.5 where sqrt((u.x - g.x) ** 2 + (u.y - g.y) ** 2) <= 1.5)"


def _spots(s, d):
    return points(s, d).groupBy("x", "y").agg(F.avg("z").alias("z"))


put("idw_interpolation", lambda s, d: ve.idw_interpolation(_spots(s, d), fx.n(s, d), "z", 1.5, north=64.0), psql("select g.row, g.col, round(v, 6) + 0.0 as value from g left join (select row, col, coalesce(avg(z) filter (dist = 0), sum(z / dist ** 2) filter (dist > 0) / sum(1 / dist ** 2) filter (dist > 0)) as v from near group by 1, 2) x on x.row = g.row and x.col = g.col", _GRID))
put("nearest_neighbour_gridding", lambda s, d: ve.nearest_neighbour_gridding(_spots(s, d), fx.n(s, d), "z", 1.5, north=64.0), psql("select g.row, g.col, round(z, 6) + 0.0 as value from g left join (select *, row_number() over (partition by row, col order by dist, ux, uy) as k from near) x on x.row = g.row and x.col = g.col and k = 1", _GRID))
put("heat_map", lambda s, d: ve.heat_map(_spots(s, d), fx.n(s, d), 1.5, north=64.0), psql("select g.row, g.col, round(coalesce(v, 0), 6) + 0.0 as value from g left join (select row, col, sum(15.0 / 16 * (1 - (dist / 1.5) ** 2) ** 2) as v from near group by 1, 2) x on x.row = g.row and x.col = g.col", _GRID))
put("extract_raster_values_at_points", lambda s, d: ve.extract_raster_values(points(s, d).select("fid", "x", "y"), [fx.n(s, d), fx.m(s, d)], north=64.0), psql("select fid, x, y, round(n.value, 6) + 0.0 as VALUE1, round(m.value, 6) + 0.0 as VALUE2 from p left join n on n.row = floor(64 - y) and n.col = floor(x) left join m on m.row = floor(64 - y) and m.col = floor(x)"))
put("raster_perimeter", lambda s, d: ve.raster_perimeter(fx.i(s, d), True), with_sql("select a.value, count(*) as perimeter from i a cross join (values (0, 1), (1, 0), (0, -1), (-1, 0)) as t(dr, dc) left join i b on b.row = a.row + dr and b.col = a.col + dc where a.value <> 0 and b.value is distinct from a.value group by 1"))
put("create_rectangular_vector_grid", lambda s, d: ve.create_rectangular_vector_grid(polygons(s, d), 25.0, 40.0).select("i", "j", ve.area().alias("area")), sql("select i, j, 1000.0::double as area from (select unnest(range(floor(min(y) / 40)::bigint, floor(max(y) / 40)::bigint + 1)) as i, floor(min(x) / 25)::bigint as j0, floor(max(x) / 25)::bigint as j1 from v) cross join lateral (select unnest(range(j0, j1 + 1)) as j)"))
put("vector_hex_binning", lambda s, d: ve.vector_hex_binning(points(s, d), 7.3).select("q", "r", "COUNT"))
put("create_hexagonal_vector_grid", lambda s, d: ve.create_hexagonal_vector_grid(polygons(s, d), 20.0).select("q", "r", ve.area().alias("area")))
