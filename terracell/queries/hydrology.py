"""Queries of hydrology, stream networks and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import hydrology as hy
from .base import put, with_sql

_STEPS = ", ".join(f"({k}, {r}, {c})" for k, (r, c) in enumerate(hy.EIGHT))
_O8 = f"o8 as (select * from (values {_STEPS}) as t(k, dr, dc))"
_FALL = "fall as (select a.row, a.col, o8.k, b.row as r2, b.col as c2, case when dr <> 0 and dc <> 0 then sqrt(2.0::double) else 1.0::double end as len, (a.value - b.value) / case when dr <> 0 and dc <> 0 then sqrt(2.0::double) else 1.0::double end as s from n a cross join o8 join n b on b.row = a.row + dr and b.col = a.col + dc where a.value > b.value)"
_BEST = "best as materialized (select * from (select *, row_number() over (partition by row, col order by s desc, k) as rn from fall) where rn = 1)"
_D8 = (_O8, _FALL, _BEST)
#: Every cell with each cell on its way down, itself included.
_WAY = "way(row, col, tr, tc, len) as (select row, col, row, col, 0.0::double from n where value is not null union all select w.row, w.col, b.r2, b.c2, w.len + b.len from way w join best b on b.row = w.tr and b.col = w.tc)"
_STREAM = "stream as materialized (select distinct r2 as row, c2 as col from best)"
_SBEST = "sbest as materialized (select best.* from best join stream using (row, col))"
_SWAY = "sway(row, col, tr, tc, len) as (select row, col, row, col, 0.0::double from stream union all select w.row, w.col, b.r2, b.c2, w.len + b.len from sway w join sbest b on b.row = w.tr and b.col = w.tc)"
_IN = "inflow as materialized (select s.row, s.col, count(b.row) as c from stream s left join sbest b on b.r2 = s.row and b.c2 = s.col group by 1, 2)"


def _sql(body: str, *more: str) -> str:
    return with_sql(body, *_D8, *more).replace("with ", "with recursive ", 1)


def _pointer(s, d):
    return hy.d8_pointer(fx.n(s, d))


def _streams(s, d):
    return hy.num_inflowing_neighbours(fx.n(s, d)).withColumn("value", F.when(F.col("value") > 0, 1.0))


put("d8_pointer", _pointer, _sql("select n.row, n.col, case when n.value is not null then coalesce(pow(2, k), 0) end::double as value from n left join best on best.row = n.row and best.col = n.col"))
put("rho8_pointer", lambda s, d: hy.rho8_pointer(fx.n(s, d), 3))
put("dinf_pointer", lambda s, d: hy.dinf_pointer(fx.n(s, d)))
put("num_inflowing_neighbours", lambda s, d: hy.num_inflowing_neighbours(fx.n(s, d)), _sql("select n.row, n.col, count(b.row)::double as value from n left join best b on b.r2 = n.row and b.c2 = n.col where n.value is not null group by 1, 2"))
put("d8_flow_accumulation", lambda s, d: hy.d8_flow_accumulation(_pointer(s, d)), _sql("select tr as row, tc as col, count(*)::double as value from way group by 1, 2", _WAY))
put("d8_flow_accumulation_log_sca", lambda s, d: hy.d8_flow_accumulation(_pointer(s, d), "specific contributing area", 4.0, 2.0, True), _sql("select tr as row, tc as col, round(ln(count(*) * 2.0), 6) as value from way group by 1, 2", _WAY))
put("rho8_flow_accumulation", lambda s, d: hy.rho8_flow_accumulation(fx.n(s, d), 3))
put("flow_accumulation_full_workflow", lambda s, d: hy.flow_accumulation_full_workflow(fx.n(s, d)))
put("basins", lambda s, d: hy.basins(_pointer(s, d)), _sql("select row, col, (tr * 1000000 + tc)::double as value from way where not exists (select 1 from best b where b.row = way.tr and b.col = way.tc)", _WAY))
put("watershed", lambda s, d: hy.watershed(_pointer(s, d), fx.n(s, d).withColumn("value", F.when(F.col("value") < -1.2, F.col("row") * 64.0 + F.col("col") + 1).otherwise(0.0))), _sql("select n.row, n.col, v::double as value from n left join (select w.row, w.col, arg_min(w.tr * 64.0 + w.tc + 1, w.len) as v from way w join n p on p.row = w.tr and p.col = w.tc and p.value < -1.2 group by 1, 2) x on x.row = n.row and x.col = n.col where n.value is not null", _WAY))
put("downslope_flowpath_length", lambda s, d: hy.downslope_flowpath_length(_pointer(s, d)), _sql("select row, col, round(max(len), 6) + 0.0 as value from way group by 1, 2", _WAY))
put("flow_length_diff", lambda s, d: hy.flow_length_diff(_pointer(s, d)))
put("max_upslope_flowpath_length", lambda s, d: hy.max_upslope_flowpath_length(fx.n(s, d)), _sql("select tr as row, tc as col, round(max(len), 6) + 0.0 as value from way group by 1, 2", _WAY))
_HEADED = "head as (select n.row, n.col from n where value is not null and not exists (select 1 from best b where b.r2 = n.row and b.c2 = n.col))"
put("average_upslope_flowpath_length", lambda s, d: hy.average_upslope_flowpath_length(fx.n(s, d)), _sql("select tr as row, tc as col, round(avg(len), 6) + 0.0 as value from way join head using (row, col) group by 1, 2", _WAY, _HEADED))
put("average_flowpath_slope", lambda s, d: hy.average_flowpath_slope(fx.n(s, d)), _sql("select w.tr as row, w.tc as col, round(case when avg(len) > 0 then degrees(atan((avg(a.value) - any_value(b.value)) / avg(len))) else 0 end, 5) + 0.0 as value from way w join head using (row, col) join n a on a.row = w.row and a.col = w.col join n b on b.row = w.tr and b.col = w.tc group by 1, 2", _WAY, _HEADED), 5)
put("elev_above_pit", lambda s, d: hy.elev_above_pit(fx.n(s, d)), _sql("select w.row, w.col, round(a.value - b.value, 6) + 0.0 as value from way w join n a on a.row = w.row and a.col = w.col join n b on b.row = w.tr and b.col = w.tc where not exists (select 1 from best x where x.row = w.tr and x.col = w.tc)", _WAY))
put("max_upslope_value", lambda s, d: hy.max_upslope_value(fx.n(s, d), fx.e(s, d)), _sql("select w.tr as row, w.tc as col, round(max(e.value), 6) + 0.0 as value from way w join e on e.row = w.row and e.col = w.col group by 1, 2", _WAY))
put("d8_mass_flux", lambda s, d: hy.d8_mass_flux(fx.n(s, d), fx.i(s, d)), _sql("select w.tr as row, w.tc as col, round(sum(coalesce(i.value, 0)), 6) + 0.0 as value from way w left join i on i.row = w.row and i.col = w.col group by 1, 2", _WAY))
put("trace_downslope_flowpaths", lambda s, d: hy.trace_downslope_flowpaths(fx.e(s, d).where("value > 2").select("row", "col"), _pointer(s, d)), _sql("select n.row, n.col, c::double as value from n left join (select w.tr, w.tc, count(*) as c from way w join e on e.row = w.row and e.col = w.col and e.value > 2 group by 1, 2) x on x.tr = n.row and x.tc = n.col where n.value is not null", _WAY))
put("downslope_distance_to_stream", lambda s, d: hy.downslope_distance_to_stream(fx.n(s, d), _streams(s, d)), _sql("select n.row, n.col, round(v, 6) + 0.0 as value from n left join (select w.row, w.col, min(len) as v from way w join stream s on s.row = w.tr and s.col = w.tc group by 1, 2) x on x.row = n.row and x.col = n.col where n.value is not null", _WAY, _STREAM))
put("elevation_above_stream", lambda s, d: hy.elevation_above_stream(fx.n(s, d), _streams(s, d)), _sql("select n.row, n.col, round(n.value - bed, 6) + 0.0 as value from n left join (select w.row, w.col, arg_min(b.value, len) as bed from way w join stream s on s.row = w.tr and s.col = w.tc join n b on b.row = w.tr and b.col = w.tc group by 1, 2) x on x.row = n.row and x.col = n.col where n.value is not null", _WAY, _STREAM))
_NET = (_STREAM, _SBEST, _SWAY, _IN)
put("distance_to_outlet", lambda s, d: hy.distance_to_outlet(_pointer(s, d), _streams(s, d)), _sql("select row, col, round(max(len), 6) + 0.0 as value from sway group by 1, 2", *_NET))
put("shreve_stream_magnitude", lambda s, d: hy.shreve_stream_magnitude(_pointer(s, d), _streams(s, d)), _sql("select tr as row, tc as col, count(*)::double as value from sway join inflow using (row, col) where c = 0 group by 1, 2", *_NET))
put("farthest_channel_head", lambda s, d: hy.farthest_channel_head(_pointer(s, d), _streams(s, d)), _sql("select tr as row, tc as col, round(max(len), 6) + 0.0 as value from sway group by 1, 2", *_NET))
put("length_of_upstream_channels", lambda s, d: hy.length_of_upstream_channels(_pointer(s, d), _streams(s, d)), _sql("select w.tr as row, w.tc as col, round(sum(coalesce(b.len, 0)), 6) + 0.0 as value from sway w left join (select r2, c2, sum(len) as len from sbest group by 1, 2) b on b.r2 = w.row and b.c2 = w.col group by 1, 2", *_NET))
#: Ways within links: they end above confluences.
_LWAY = "lway(row, col, tr, tc) as (select row, col, row, col from stream union all select w.row, w.col, b.r2, b.c2 from lway w join sbest b on b.row = w.tr and b.col = w.tc join inflow i on i.row = b.r2 and i.col = b.c2 and i.c < 2)"
_LINK = "link as materialized (select w.row, w.col, w.tr, w.tc from lway w where not exists (select 1 from sbest b join inflow i on i.row = b.r2 and i.col = b.c2 and i.c < 2 where b.row = w.tr and b.col = w.tc))"
_LEN = "lens as (select l.tr, l.tc, sum(coalesce(b.len, 0)) as len, max((i.c = 0)::int) as outer_, max(n.value) - min(n.value) as fall from link l left join sbest b on b.row = l.row and b.col = l.col join inflow i on i.row = l.row and i.col = l.col join n on n.row = l.row and n.col = l.col group by 1, 2)"
_LINKS = (*_NET, _LWAY, _LINK, _LEN)
put("stream_link_identifier", lambda s, d: hy.stream_link_identifier(_pointer(s, d), _streams(s, d)), _sql("select row, col, (tr * 1000000 + tc)::double as value from link", *_LINKS))
put("stream_link_length", lambda s, d: hy.stream_link_length(_pointer(s, d), _streams(s, d)), _sql("select l.row, l.col, round(len, 6) + 0.0 as value from link l join lens x on x.tr = l.tr and x.tc = l.tc", *_LINKS))
put("stream_link_slope", lambda s, d: hy.stream_link_slope(_pointer(s, d), _streams(s, d), fx.n(s, d)), _sql("select l.row, l.col, round(case when len > 0 then 100 * fall / len else 0 end, 6) + 0.0 as value from link l join lens x on x.tr = l.tr and x.tc = l.tc", *_LINKS))
put("stream_link_class", lambda s, d: hy.stream_link_class(_pointer(s, d), _streams(s, d)), _sql("select i.row, i.col, (case when b.row is null then 5 when i.c = 0 then 3 when i.c > 1 then 4 when m.m > 1 then 2 else 1 end)::double as value from inflow i left join sbest b on b.row = i.row and b.col = i.col join (select w.tr, w.tc, count(*) filter (h.c = 0) as m from sway w join inflow h on h.row = w.row and h.col = w.col group by 1, 2) m on m.tr = i.row and m.tc = i.col".replace("left join sbest b on b.row = i.row and b.col = i.col", "left join (select q.row, q.col from sbest q join stream t on t.row = q.r2 and t.col = q.c2) b on b.row = i.row and b.col = i.col"), *_NET))
put("remove_short_streams", lambda s, d: hy.remove_short_streams(_pointer(s, d), _streams(s, d), 1.2), _sql("select l.row, l.col, (case when outer_ = 1 and len < 1.2 then null else 1 end)::double as value from link l join lens x on x.tr = l.tr and x.tc = l.tc", *_LINKS))
put("strahler_stream_order", lambda s, d: hy.strahler_stream_order(_pointer(s, d), _streams(s, d)))
_HOPS = "hops(row, col, tr, tc, k) as (select row, col, row, col, 0 from n where value is not null union all select h.row, h.col, b.r2, b.c2, h.k + 1 from hops h join best b on b.row = h.tr and b.col = h.tc)"
put("d8_mass_flux_losses", lambda s, d: hy.d8_mass_flux(fx.n(s, d), fx.i(s, d), fx.e(s, d).withColumn("value", F.lit(50.0)), fx.e(s, d).withColumn("value", F.lit(0.25))), _sql("select h.tr as row, h.tc as col, round(sum((coalesce(i.value, 0) - 0.125 * coalesce(c, 0)) * pow(0.5, k)), 6) + 0.0 as value from hops h left join i on i.row = h.row and i.col = h.col left join (select r2, c2, count(*) as c from best group by 1, 2) x on x.r2 = h.row and x.c2 = h.col group by 1, 2", _HOPS))
put("cost_allocation", lambda s, d: hy.cost_allocation(fx.n(s, d).withColumn("value", F.when(F.col("value") < -1.2, F.col("row") * 64.0 + F.col("col") + 1).otherwise(0.0)), _pointer(s, d)), _sql("select n.row, n.col, v::double as value from n left join (select w.row, w.col, arg_min(w.tr * 64.0 + w.tc + 1, w.len) as v from way w join n p on p.row = w.tr and p.col = w.tc and p.value < -1.2 group by 1, 2) x on x.row = n.row and x.col = n.col where n.value is not null", _WAY))
put("topological_stream_order", lambda s, d: hy.topological_stream_order(_pointer(s, d), _streams(s, d)), _sql("select w.row, w.col, (1 + count(*) filter (i.c > 1 and (w.tr <> w.row or w.tc <> w.col)))::double as value from sway w join inflow i on i.row = w.tr and i.col = w.tc group by 1, 2", *_NET))
_KID = "kid as materialized (select b.row, b.col, row_number() over (partition by r2, c2 order by round(f.d + b.len, 6) desc, b.row, b.col) as rn from sbest b join (select tr, tc, max(len) as d from sway group by 1, 2) f on f.tr = b.row and f.tc = b.col)"
_HACK = "hack as (select w.row, w.col, (1 + count(*) filter (k.rn > 1))::double as value from sway w left join kid k on k.row = w.tr and k.col = w.tc group by 1, 2)"
put("hack_stream_order", lambda s, d: hy.hack_stream_order(_pointer(s, d), _streams(s, d)), _sql("select row, col, value from hack", *_NET, _KID, _HACK))
put("find_main_stem", lambda s, d: hy.find_main_stem(_pointer(s, d), _streams(s, d)), _sql("select row, col, case when value = 1 then 1.0::double end as value from hack", *_NET, _KID, _HACK))
put("tributary_identifier", lambda s, d: hy.tributary_identifier(_pointer(s, d), _streams(s, d)), _sql("select w.row, w.col, arg_min(w.tr * 1000000 + w.tc, w.len)::double as value from sway w left join kid k on k.row = w.tr and k.col = w.tc where k.row is null or k.rn > 1 group by 1, 2", *_NET, _KID))
put("horton_stream_order", lambda s, d: hy.horton_stream_order(_pointer(s, d), _streams(s, d)))
put("strahler_order_basins", lambda s, d: hy.strahler_order_basins(_pointer(s, d), _streams(s, d)))
put("subbasins", lambda s, d: hy.subbasins(_pointer(s, d), _streams(s, d)), _sql("select n.row, n.col, v::double as value from n left join (select w.row, w.col, arg_min(l.tr * 1000000 + l.tc, w.len) as v from way w join link l on l.row = w.tr and l.col = w.tc group by 1, 2) x on x.row = n.row and x.col = n.col where n.value is not null", _WAY, *_LINKS))
put("long_profile", lambda s, d: hy.long_profile(_pointer(s, d), _streams(s, d), fx.n(s, d)), _sql("select w.row, w.col, round(max(len), 6) + 0.0 as distance, round(any_value(n.value), 6) + 0.0 as z from sway w join n on n.row = w.row and n.col = w.col group by 1, 2", *_NET))
put("fill_depressions", lambda s, d: hy.fill_depressions(fx.n(s, d)))
put("depth_in_sink", lambda s, d: hy.depth_in_sink(fx.n(s, d)))
put("upslope_depression_storage", lambda s, d: hy.upslope_depression_storage(fx.n(s, d)))
put("sink", lambda s, d: hy.sink(fx.n(s, d)))


def _clump_sql(diag: bool) -> str:
    steps = "(0, 1), (1, 0), (0, -1), (-1, 0)" + (", (1, 1), (1, -1), (-1, 1), (-1, -1)" if diag else "")
    body = "select row, col, dense_rank() over (order by root)::double as value from (select row, col, min(id) as root from reach group by 1, 2)"
    return with_sql(body, f"st as (select * from (values {steps}) as t(dr, dc))", "own as (select row, col, value from z2 where value is not null)", "reach(row, col, id) as (select row, col, row::bigint * 100 + col from own union select b.row, b.col, r.id from reach r join own a on a.row = r.row and a.col = r.col cross join st join own b on b.row = a.row + dr and b.col = a.col + dc and b.value = a.value where true)").replace("with ", "with recursive ", 1).replace("st as (select", "z2 as (select row, col, case when value > 0.9 then value when value < -0.9 then -1 end as value from (select row, col, case when value > 0.9 then 1.0 else value end as value from e)), st as (select", 1)


def _patches(s, d):
    return fx.e(s, d).withColumn("value", F.when(F.col("value") > 0.9, 1.0).when(F.col("value") < -0.9, -1.0))


put("clump", lambda s, d: hy.clump(_patches(s, d)), _clump_sql(False))
put("clump_diagonal", lambda s, d: hy.clump(_patches(s, d), diag=True), _clump_sql(True))
_POINTS = "pts as (select row * 64 + col as id, row, col from e where value > 1.5)"


def _points(s, d):
    """The peaks of the raster."""
    return fx.e(s, d).where("value > 1.5").select((F.col("row") * 64 + F.col("col")).alias("id"), "row", "col")


put("snap_pour_points", lambda s, d: hy.snap_pour_points(_points(s, d), fx.n(s, d), 3), with_sql("select id, row, col from (select p.id, n.row, n.col, row_number() over (partition by p.id order by n.value desc, n.row, n.col) as rn from pts p join n on n.row between p.row - 3 and p.row + 3 and n.col between p.col - 3 and p.col + 3 and n.value is not null) where rn = 1", _POINTS))
put("jenson_snap_pour_points", lambda s, d: hy.jenson_snap_pour_points(_points(s, d), fx.i(s, d), 4), with_sql("select id, row, col from (select p.id, i.row, i.col, row_number() over (partition by p.id order by (i.row - p.row) * (i.row - p.row) + (i.col - p.col) * (i.col - p.col), i.row, i.col) as rn from pts p join i on i.row between p.row - 4 and p.row + 4 and i.col between p.col - 4 and p.col + 4 and i.value > 0) where rn = 1", _POINTS))


def _targets(s, d):
    return fx.e(s, d).withColumn("value", F.when(F.col("value") > 2.2, F.col("row") + 1.0).otherwise(0.0))


_TARGETS = "tg as (select row, col, row + 1.0 as v from e where value > 2.2)"
put("euclidean_distance", lambda s, d: hy.euclidean_distance(_targets(s, d), 2.0))
put("euclidean_allocation", lambda s, d: hy.euclidean_allocation(_targets(s, d)))
put("buffer_raster", lambda s, d: hy.buffer_raster(_targets(s, d), 2.5), with_sql("select e.row, e.col, (exists (select 1 from tg where tg.row between e.row - 2 and e.row + 2 and tg.col between e.col - 2 and e.col + 2 and (tg.row - e.row) ** 2 + (tg.col - e.col) ** 2 <= 6.25))::int::double as value from e", _TARGETS))
put("elevation_above_stream_euclidean", lambda s, d: hy.elevation_above_stream_euclidean(fx.e(s, d), _targets(s, d)))
put("cost_distance", lambda s, d: hy.cost_distance(_targets(s, d), fx.e(s, d).withColumn("value", F.abs("value") + 0.1)))
