"""Queries of the pointwise operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import cellmath as cm
from .base import cell_sql, put, with_sql

#: Where DuckDB's spelling differs from Spark's.
_UNARY_SQL = {
    "Exp2": "pow(2, value)",
    "Ceil": "ceil(value)",
    "Floor": "floor(value)",
    "Reciprocal": "case when value = 0 then 'inf'::double else 1 / value end",
    "ArcCos": "case when value between -1 and 1 then acos(value) end",
    "Arcosh": "case when value >= 1 and value <= 1 then acosh(value) end",
    "ArcSin": "case when value between -1 and 1 then asin(value) end",
    "Arsinh": "case when value between -1 and 1 then asinh(value) end",
    "Ln": "case when value > 0 then ln(value) end",
    "Log2": "case when value > 0 then log2(value) end",
    "Log10": "case when value > 0 then log10(value) end",
    "Negate": "case when value <> 0 then -value else value end",
}
#: Inputs kept in the function's domain, as NaN has no agreed digest.
_SCALED = {"Artanh": ("value / 10", "value / 10"), "SquareRoot": ("abs(value)", "abs(value)"), "Arcosh": ("if(value > 0.5, 1.0D, null)", "case when value > 0.5 then 1.0 end"), "Exp": ("value / 2", "value / 2"), "Sinh": ("value / 2", "value / 2"), "Cosh": ("value / 2", "value / 2"), "ArcCos": ("value / 2", "value / 2"), "ArcSin": ("value / 2", "value / 2"), "Tan": ("value / 20", "value / 20")}


def _unary(name, spark, sf_dir):
    cells = fx.n(spark, sf_dir)
    if name in _SCALED:
        cells = cells.withColumn("value", F.expr(_SCALED[name][0]))
    return cm.unary(name, cells)


for _name in cm.UNARY:
    _sql = _UNARY_SQL.get(_name, cm.UNARY[_name])
    _from = f"(select row, col, {_SCALED[_name][1]} as value from n)" if _name in _SCALED else "n"
    put(f"unary_{_name}", partial(_unary, _name), cell_sql(f"{_sql} from {_from}"))

_BINARY_SQL = {
    "Divide": "a / nullif(b, 0)",
    "Modulo": "a - trunc(a / nullif(b, 0)) * b",
    "IntegerDivision": "trunc(trunc(a) / nullif(trunc(b), 0))",
    "EqualTo": "(a = b)::int",
    "NotEqualTo": "(a <> b)::int",
    "And": "(a <> 0 and b <> 0)::int",
    "Or": "(a <> 0 or b <> 0)::int",
    "Not": "(a <> 0 and b = 0)::int",
    "Xor": "((a <> 0) <> (b <> 0))::int",
    "Power": "pow(abs(a), b)",
}
_WHOLE = {"EqualTo", "NotEqualTo", "And", "Or", "Not", "Xor", "IntegerDivision", "Modulo"}


def _both(sql: str, a: str = "n", b: str = "m") -> str:
    return cell_sql(f"case when a is not null and b is not null then {sql} end from (select row, col, {a}.value as a, {b}.value as b from {a} join {b} using (row, col))")


def _binary(name, spark, sf_dir):
    if name in _WHOLE:
        return cm.binary(name, fx.i(spark, sf_dir), fx.j(spark, sf_dir))
    a = fx.n(spark, sf_dir)
    return cm.binary(name, cm.unary("AbsoluteValue", a) if name == "Power" else a, fx.m(spark, sf_dir))


for _name in cm.BINARY:
    put(f"binary_{_name}", partial(_binary, _name), _both(_BINARY_SQL.get(_name, cm.BINARY[_name]), *(("i", "j") if _name in _WHOLE else ("n", "m"))))
for _name in ("Add", "Subtract", "Multiply", "Divide"):
    put(f"inplace_{_name}", (lambda n: lambda s, d: cm.binary(n, fx.n(s, d), 2.5))(_name), cell_sql(f"{cm.BINARY[_name].replace('nullif(b, 0)', '2.5').replace('a', 'value').replace('b', '2.5')} from n"))
put("greater_than", lambda s, d: cm.greater_than(fx.n(s, d), fx.m(s, d)), _both("(a > b)::int"))
put("greater_than_or_equal", lambda s, d: cm.greater_than(fx.i(s, d), fx.j(s, d), True), _both("(a >= b)::int", "i", "j"))
put("less_than", lambda s, d: cm.less_than(fx.n(s, d), 0.5), cell_sql("(value < 0.5)::int from n"))
put("less_than_or_equal", lambda s, d: cm.less_than(fx.i(s, d), fx.j(s, d), True), _both("(a <= b)::int", "i", "j"))
put("is_nodata", lambda s, d: cm.is_nodata(fx.n(s, d)), cell_sql("(value is null)::int from n"))
put("truncate", lambda s, d: cm.truncate(fx.n(s, d), 2), cell_sql("trunc(value * 100) / 100 from n"))
put("raster_calculator", lambda s, d: cm.raster_calculator("if(a > b, a - b, sqrt(abs(a)) * c)", a=fx.n(s, d), b=fx.m(s, d), c=fx.k(s, d)), cell_sql("case when a is not null and b is not null and c is not null then case when a > b then a - b else sqrt(abs(a)) * c end end from (select row, col, n.value as a, m.value as b, k.value as c from n join m using (row, col) join k using (row, col))"))
put("conditional_evaluation", lambda s, d: cm.conditional_evaluation(fx.n(s, d), "value > 0.5 and col > 3", 10.0, -1.0), cell_sql("case when value is null then null when value > 0.5 and col > 3 then 10 else -1 end from n"))
put("convert_nodata_to_zero", lambda s, d: cm.convert_nodata_to_zero(fx.n(s, d)), cell_sql("coalesce(value, 0) from n"))
put("set_nodata_value", lambda s, d: cm.set_nodata_value(fx.i(s, d), 1.0), cell_sql("case when value <> 1 then value end from i"))
put("modify_nodata_value", lambda s, d: cm.modify_nodata_value(fx.n(s, d), -9999.0), with_sql("select row, col, round(value, 6) + 0.0 as value, -9999.0::double as nodata from n"))
put("new_raster_from_base", lambda s, d: cm.new_raster_from_base(fx.n(s, d), 3.5), cell_sql("3.5 from n"))
put("update_nodata_cells", lambda s, d: cm.update_nodata_cells(fx.n(s, d), fx.m(s, d)), cell_sql("coalesce(a, b) from (select row, col, n.value as a, m.value as b from n left join m using (row, col))"))
put("raster_cell_assignment", lambda s, d: cm.raster_cell_assignment(fx.n(s, d), "x", west=10.0, resolution=2.0), cell_sql("10 + (col + 0.5) * 2 from n"))
put("create_plane", lambda s, d: cm.create_plane(fx.n(s, d), 15.0, 90.0, 5.0, 1.0, 100), cell_sql("sin(radians(270)) * tan(radians(15)) * (col + 0.5) + cos(radians(270)) * tan(radians(15)) * (100 - row - 0.5) + 5 from n"))
put("reclass", lambda s, d: cm.reclass(fx.n(s, d), [(1, -9, 0), (2, -1, 1), (3, 1, 2)]), cell_sql("case when value >= -9 and value < 0 then 1 when value >= -1 and value < 1 then 2 when value >= 1 and value < 2 then 3 else value end from n"))
put("reclass_assign", lambda s, d: cm.reclass(fx.i(s, d), [(10, 1), (20, -1)], True), cell_sql("case value when 1 then 10 when -1 then 20 else value end from i"))
put("reclass_from_file", lambda s, d: cm.reclass_from_file(fx.n(s, d), s.createDataFrame([(1.0, -9.0, 0.0), (2.0, 0.0, 1.0)], "new double, lo double, hi double")), cell_sql("case when value >= -9 and value < 0 then 1 when value >= 0 and value < 1 then 2 else value end from n"))
put("reclass_equal_interval", lambda s, d: cm.reclass_equal_interval(fx.n(s, d), 0.5, -1.0, 1.0), cell_sql("case when value between -1 and 1 then floor(value / 0.5) * 0.5 else value end from n"))

_STACK = "s as (select row, col, value, 0 as layer from n union all select row, col, value, 1 from m union all select row, col, value, 2 from k)"
_WHOLE_STACK = "t as (select row, col, value, 0 as layer from i union all select row, col, value, 1 from j)"


def _stack(s, d):
    return [fx.n(s, d), fx.m(s, d), fx.k(s, d)]


def _overlay_sql(how: str, source: str = "s") -> str:
    return with_sql(f"select row, col, round(({how})::double, 6) + 0.0 as value from {source} group by row, col", _STACK, _WHOLE_STACK)


_OVERLAY_SQL = {
    "SumOverlay": "sum(value)",
    "AverageOverlay": "avg(value)",
    "MaxOverlay": "max(value)",
    "MinOverlay": "min(value)",
    "MaxAbsoluteOverlay": "max(abs(value))",
    "MinAbsoluteOverlay": "min(abs(value))",
    "MultiplyOverlay": "product(value)",
    "HighestPosition": "arg_max(layer + 1, value * 1e6 - layer * 1e-7) filter (value is not null)",
    "LowestPosition": "arg_min(layer + 1, value * 1e6 + layer * 1e-7) filter (value is not null)",
}
for _name, _how in cm._OVERLAYS.items():
    put(f"overlay_{_name}", (lambda h: lambda s, d: cm.overlay(_stack(s, d), h()))(_how), _overlay_sql(_OVERLAY_SQL[_name]))
put("count_if", lambda s, d: cm.count_if([fx.i(s, d), fx.j(s, d)], 1.0), _overlay_sql("nullif(count(*) filter (value = 1), 0)", "t"))
for _name, _test, _how in (("equal_to", "=", cm.percent_equal_to), ("greater_than", ">", cm.percent_greater_than), ("less_than", "<", cm.percent_less_than)):
    put(f"percent_{_name}", (lambda h: lambda s, d: h([fx.i(s, d), fx.j(s, d)], fx.i(s, d)))(_how), with_sql(f"select row, col, round(case when max(c) is null then null when count(value) = 0 then 0 else 100.0 * count(*) filter (value {_test} c) / count(value) end::double, 6) + 0.0 as value from (select t.row, t.col, t.value, i.value as c from t join i using (row, col)) group by row, col", _WHOLE_STACK))
put("pick_from_list", lambda s, d: cm.pick_from_list(_stack(s, d), fx.e(s, d).withColumn("value", F.col("col") % 3.0)), cell_sql("case col % 3 when 0 then n.value when 1 then m.value else k.value end from n join m using (row, col) join k using (row, col)"))
put("weighted_sum", lambda s, d: cm.weighted_sum(_stack(s, d), [1, 2, 1]), _overlay_sql("case when count(value) = 3 then sum(value * case layer when 1 then 0.5 else 0.25 end) end"))
put("weighted_overlay", lambda s, d: cm.weighted_overlay(_stack(s, d), [1, 2, 1], [False, True, False], [fx.i(s, d)], 10.0), with_sql("select row, col, round((case when i.value is null then null when i.value <= 0 then 0 else v end)::double, 6) + 0.0 as value from (select row, col, case when count(value) = 3 then sum(10 * case layer when 1 then 0.5 else 0.25 end * case layer when 1 then 1 - (value - lo) / (hi - lo) else (value - lo) / (hi - lo) end) end as v from (select *, min(value) over (partition by layer) as lo, max(value) over (partition by layer) as hi from s) group by row, col) join i using (row, col)", _STACK))
for _how, _sql in (("mean", "avg(value)"), ("sum", "sum(value)"), ("maximum", "max(value)"), ("minimum", "min(value)"), ("range", "max(value) - min(value)")):
    put(f"aggregate_raster_{_how}", (lambda h: lambda s, d: cm.aggregate_raster(fx.n(s, d), 4, h))(_how), with_sql(f"select (row // 4)::int as row, (col // 4)::int as col, round(({_sql})::double, 6) + 0.0 as value from n group by 1, 2"))
put("rgb_to_ihs", lambda s, d: cm.rgb_to_ihs(*[x.withColumn("value", F.pmod(F.abs(F.round(F.coalesce("value", F.lit(0.0)) * 40)), F.lit(256.0))) for x in _stack(s, d)]),
    with_sql("select row, col, round((r + g + b) / 3, 6) + 0.0 as intensity, round(case when r + g + b - 3 * lo = 0 then 0 else 2 * pi() / 3 * case when lo = b then (g - b) / (r + g + b - 3 * lo) when lo = r then (b - r) / (r + g + b - 3 * lo) + 1 else (r - g) / (r + g + b - 3 * lo) + 2 end end, 6) + 0.0 as hue, round(case when r + g + b = 0 then 0 else 1 - 3 * lo / (r + g + b) end, 6) + 0.0 as saturation from (select *, least(r, g, b) as lo from (select row, col, fmod(abs(round(coalesce(n.value, 0) * 40)), 256) / 255 as r, fmod(abs(round(coalesce(m.value, 0) * 40)), 256) / 255 as g, fmod(abs(round(coalesce(k.value, 0) * 40)), 256) / 255 as b from n join m using (row, col) join k using (row, col)))"))
put("create_colour_composite", lambda s, d: cm.create_colour_composite(*[x.withColumn("value", F.abs("value") * 40) for x in _stack(s, d)]), cell_sql("case when n.value is not null and m.value is not null and k.value is not null then 4278190080 + least(floor(abs(k.value) * 40), 255) * 65536 + least(floor(abs(m.value) * 40), 255) * 256 + least(floor(abs(n.value) * 40), 255) end from n join m using (row, col) join k using (row, col)"))
put("split_colour_composite", lambda s, d: cm.split_colour_composite(fx.e(s, d).withColumn("value", F.floor(F.abs("value") * 1e6).cast("double"))), with_sql("select row, col, (v & 255)::double as red, ((v >> 8) & 255)::double as green, ((v >> 16) & 255)::double as blue from (select row, col, floor(abs(value) * 1e6)::bigint as v from e)"))
put("normalized_difference_index", lambda s, d: cm.normalized_difference_index(cm.unary("AbsoluteValue", fx.n(s, d)), cm.unary("AbsoluteValue", fx.m(s, d)), 0.5), _both("(abs(a) - abs(b)) / (abs(a) + abs(b) + 0.5)"))
put("change_vector_analysis", lambda s, d: cm.change_vector_analysis([fx.n(s, d), fx.m(s, d)], [fx.k(s, d), fx.i(s, d)]), with_sql("select row, col, round(case when x is not null and y is not null then sqrt(x * x + y * y) end, 6) + 0.0 as magnitude, (case when x is not null and y is not null then (x > 0)::int + 2 * (y > 0)::int end)::double as direction from (select row, col, k.value - n.value as x, i.value - m.value as y from n join m using (row, col) join k using (row, col) join i using (row, col))"))
put("flip_image", lambda s, d: cm.flip_image(fx.n(s, d), "both"), with_sql("select ((select max(row) from n) - row)::int as row, (63 - col)::int as col, round(value, 6) + 0.0 as value from n"))
put("gamma_correction", lambda s, d: cm.gamma_correction(cm.unary("AbsoluteValue", fx.n(s, d)), 0.5), cell_sql("pow(abs(value), 0.5) from n"))
_SLOPE = "o as (select row, col, abs(value) * 10 as value from n), sca as (select row, col, abs(value) + 1 as value from m)"


def _slope(s, d):
    return fx.n(s, d).withColumn("value", F.abs("value") * 10), fx.m(s, d).withColumn("value", F.abs("value") + 1)


def _pair_sql(sql: str) -> str:
    return with_sql(f"select row, col, round((case when a is not null and b is not null then {sql} end)::double, 6) + 0.0 as value from (select row, col, sca.value as a, o.value as b from sca join o using (row, col))", _SLOPE)


put("wetness_index", lambda s, d: cm.wetness_index(*reversed(_slope(s, d))), _pair_sql("case when b <> 0 then ln(a / tan(radians(b))) end"))
put("stream_power_index", lambda s, d: cm.stream_power_index(*reversed(_slope(s, d)), 1.2), _pair_sql("pow(a, 1.2) * tan(radians(b))"))
put("sediment_transport_index", lambda s, d: cm.sediment_transport_index(*[x.withColumn("value", F.col("value") / 10) for x in reversed(_slope(s, d))]), _pair_sql("1.4 * pow(a / 10 / 22.13, 0.4) * pow(sin(radians(b / 10)) / 0.0896, 1.3)"))
put("relative_aspect", lambda s, d: cm.relative_aspect(fx.n(s, d).withColumn("value", F.pmod(F.col("value") * 100, F.lit(360.0))), 30.0), cell_sql("case when abs(v - 30) > 180 then 360 - abs(v - 30) else abs(v - 30) end from (select row, col, fmod(fmod(value * 100, 360) + 360, 360) as v from n)"))
put("extract_streams", lambda s, d: cm.extract_streams(fx.n(s, d), 1.0, True), cell_sql("case when value is null then null when value > 1 then 1 else 0 end from n"))
