"""Queries of image filters and terrain operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import image as im
from ..operators import terrain as tr
from .base import put, with_sql


def _w(half: int, source: str = "n", name: str = "w") -> str:
    """Every cell with every place of its window; other is null off the grid."""
    return f"{name} as (select a.row, a.col, a.value, o.dr, o.dc, b.value as other, b.row is not null as here from {source} a cross join (select x.dr, y.dc from (select unnest(range(-{half}, {half + 1})) as dr) x, (select unnest(range(-{half}, {half + 1})) as dc) y) o left join {source} b on b.row = a.row + o.dr and b.col = a.col + o.dc)"


def _window_sql(how: str, half: int = 1, source: str = "n") -> str:
    return with_sql(f"select row, col, round((case when any_value(value) is not null then {how} end)::double, 6) + 0.0 as value from w group by row, col", _w(half, source))


_OWN = "case when row + dr > 0 and col + dc > 0 then other end"
_MEAN, _N = f"coalesce(avg({_OWN}), 0)", f"count({_OWN})"
_SD = f"coalesce(sqrt(greatest(avg(({_OWN}) * ({_OWN})) - avg({_OWN}) * avg({_OWN}), 0)), 0)"
put("mean_filter", lambda s, d: im.mean_filter(fx.n(s, d), 5), _window_sql(_MEAN, 2))
put("mean_filter_clipped_window", lambda s, d: im.mean_filter(fx.n(s, d), 3, strict=False), _window_sql("avg(other)"))
put("total_filter", lambda s, d: im.total_filter(fx.n(s, d), 3), _window_sql(f"coalesce(sum({_OWN}), 0)"))
put("standard_deviation_filter", lambda s, d: im.standard_deviation_filter(fx.n(s, d), 5), _window_sql(_SD, 2).replace("::double, 6)", "::double, 5)"), 5)
put("high_pass_filter", lambda s, d: im.high_pass_filter(fx.n(s, d), 3), _window_sql(f"any_value(value) - {_MEAN}"))
put("adaptive_filter", lambda s, d: im.adaptive_filter(fx.n(s, d), 5, threshold=1.0), _window_sql(f"case when {_SD} > 0 and abs(any_value(value) - {_MEAN}) > {_SD} then {_MEAN} else any_value(value) end", 2))
put("maximum_filter", lambda s, d: im.maximum_filter(fx.n(s, d), 5), _window_sql("max(other)", 2))
put("minimum_filter", lambda s, d: im.minimum_filter(fx.n(s, d), 5), _window_sql("min(other)", 2))
put("range_filter", lambda s, d: im.range_filter(fx.n(s, d), 3), _window_sql("max(other) - min(other)"))


def _morph(first: str, then: str, out: str) -> str:
    return with_sql(f"select g.row, g.col, round(({out})::double, 6) + 0.0 as value from n g join (select row, col, case when any_value(value) is not null then {then}(other) end as m from w2 group by row, col) x on g.row = x.row and g.col = x.col", _w(1), f"f as (select row, col, case when any_value(value) is not null then {first}(other) end as value from w group by row, col)", _w(1, "f", "w2"))


put("opening", lambda s, d: im.opening(fx.n(s, d), 3), _morph("min", "max", "m"))
put("closing", lambda s, d: im.closing(fx.n(s, d), 3), _morph("max", "min", "m"))
put("tophat_transform", lambda s, d: im.tophat_transform(fx.n(s, d), 3), _morph("min", "max", "g.value - m"))
put("tophat_transform_black", lambda s, d: im.tophat_transform(fx.n(s, d), 3, variant="black"), _morph("max", "min", "m - g.value"))
put("integral_image", lambda s, d: im.integral_image(fx.n(s, d)), with_sql("select row, col, round(sum(s) over (partition by col order by row), 5) + 0.0 as value from (select row, col, sum(coalesce(value, 0)) over (partition by row order by col) as s from n)"), 5)


def _kernel(k, other: str = "coalesce(other, value)") -> str:
    k = np.asarray(k, float)
    h = k.shape[0] // 2
    return "sum(" + other + " * (case " + " ".join(f"when dr = {r - h} and dc = {c - h} then {float(k[r, c])!r}" for r in range(k.shape[0]) for c in range(k.shape[1]) if k[r, c]) + " else 0 end)::double)"


def _gradient(k) -> str:
    k = np.asarray(k, float)
    return f"sqrt(pow({_kernel(k)}, 2) + pow({_kernel(k.T)}, 2))"


put("sobel_filter", lambda s, d: im.sobel_filter(fx.n(s, d)), _window_sql(_gradient(im._SOBEL)))
put("sobel_filter_5x5", lambda s, d: im.sobel_filter(fx.n(s, d), "5x5"), _window_sql(_gradient(im._SOBEL5), 2))
put("prewitt_filter", lambda s, d: im.prewitt_filter(fx.n(s, d)), _window_sql(_gradient(im._PREWITT)))
put("scharr_filter", lambda s, d: im.scharr_filter(fx.n(s, d)), _window_sql(_gradient(im._SCHARR)))
_A, _B = np.zeros((3, 3)), np.zeros((3, 3))
_A[1, 1], _A[2, 2], _B[1, 2], _B[2, 1] = 1, -1, 1, -1
put("roberts_cross_filter", lambda s, d: im.roberts_cross_filter(fx.n(s, d)), _window_sql(f"abs({_kernel(_A)}) + abs({_kernel(_B)})"))
for _name, _k in im._LAPLACE.items():
    put(f"laplacian_filter_{_name[:3]}_{_name[4]}", (lambda v: lambda s, d: im.laplacian_filter(fx.n(s, d), v))(_name), _window_sql(_kernel(_k), len(_k) // 2))
for _name, (_dr, _dc) in im._TOWARDS.items():
    _k = np.zeros((3, 3))
    _k[1 + _dr, 1 + _dc], _k[1 - _dr, 1 - _dc] = -1, 1
    put(f"emboss_filter_{_name}", (lambda v: lambda s, d: im.emboss_filter(fx.n(s, d), v))(_name), _window_sql(_kernel(-_k if _name in ("e", "w") else _k)))
for _name, _k in im._LINES.items():
    put(f"line_detection_filter_{_name}", (lambda v: lambda s, d: im.line_detection_filter(fx.n(s, d), v))(_name), _window_sql(_kernel(_k)))
_U = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
put("user_defined_weights_filter", lambda s, d: im.user_defined_weights_filter(fx.n(s, d), _U, True), _window_sql(f"{_kernel(_U, 'other')} / {_kernel(_U, '(other is not null)::int')}"))


def _gaussian_sql(sigma: float, half: int, extra: str = "1") -> str:
    g = f"exp(-(dr * dr + dc * dc) / {2 * sigma * sigma!r}) * {extra}"
    return f"sum(other * {g}) / sum(case when other is not null then {g} end)"


put("gaussian_filter", lambda s, d: im.gaussian_filter(fx.n(s, d), 0.75), _window_sql(_gaussian_sql(0.75, 2), 2))
put("bilateral_filter", lambda s, d: im.bilateral_filter(fx.n(s, d), 0.75, 1.0), _window_sql(_gaussian_sql(0.75, 2, "exp(-(other - value) * (other - value) / 2.0)"), 2))
put("high_pass_bilateral_filter", lambda s, d: im.high_pass_bilateral_filter(fx.n(s, d), 0.75, 1.0), _window_sql("any_value(value) - " + _gaussian_sql(0.75, 2, "exp(-(other - value) * (other - value) / 2.0)"), 2))
put("diff_of_gaussian_filter", lambda s, d: im.diff_of_gaussian_filter(fx.n(s, d), 0.5, 1.1), _window_sql("sum(case when abs(dr) <= 2 and abs(dc) <= 2 then other * exp(-(dr * dr + dc * dc) / 0.5) end) / sum(case when abs(dr) <= 2 and abs(dc) <= 2 and other is not null then exp(-(dr * dr + dc * dc) / 0.5) end) - " + _gaussian_sql(1.1, 3), 3))
put("laplacian_of_gaussian_filter", lambda s, d: im.laplacian_of_gaussian_filter(fx.n(s, d), 0.75), _window_sql(f"sum(coalesce(other, value) * (-1 / (pi() * {0.75**4!r})) * (1 - (dr * dr + dc * dc) / {2 * 0.75**2!r}) * exp(-(dr * dr + dc * dc) / {2 * 0.75**2!r}))", 3))
put("unsharp_masking", lambda s, d: im.unsharp_masking(fx.n(s, d), 0.75, 50.0, 0.1), _window_sql(f"case when abs(any_value(value) - {_gaussian_sql(0.75, 2)}) > 0.1 then any_value(value) + 0.5 * (any_value(value) - {_gaussian_sql(0.75, 2)}) else any_value(value) end", 2))
put("fast_almost_gaussian_filter", lambda s, d: im.fast_almost_gaussian_filter(fx.n(s, d)))
_SORTED = "list_sort(list(floor(other * 100)) filter (other is not null))"
put("median_filter", lambda s, d: im.median_filter(fx.n(s, d), 5), _window_sql(f"({_SORTED})[greatest(count(other) // 2, 1)] / 100", 2))
put("high_pass_median_filter", lambda s, d: im.high_pass_median_filter(fx.n(s, d), 3), _window_sql(f"any_value(value) - ({_SORTED})[greatest(count(other) // 2, 1)] / 100"))
put("percentile_filter", lambda s, d: im.percentile_filter(fx.n(s, d), 5), _window_sql("100.0 * count(*) filter (floor(other * 100) < floor(value * 100)) / count(other)", 2))
put("majority_filter", lambda s, d: im.majority_filter(fx.i(s, d), 3), with_sql("select row, col, arg_min(other, struct_pack(a := -c, b := other))::double as value from (select row, col, other, count(*) as c from w where value is not null and other is not null group by row, col, other) group by row, col union all select row, col, null from i where value is null", _w(1, "i")))
put("diversity_filter", lambda s, d: im.diversity_filter(fx.i(s, d), 3), _window_sql("count(distinct other)", 1, "i"))
put("olympic_filter", lambda s, d: im.olympic_filter(fx.n(s, d), 3), _window_sql("case when count(other) > 2 then (sum(other) - min(other) - max(other)) / (count(other) - 2) else any_value(value) end"))
_OTHERS = "other) filter (dr <> 0 or dc <> 0"
put("conservative_smoothing_filter", lambda s, d: im.conservative_smoothing_filter(fx.n(s, d), 3), _window_sql(f"case when count({_OTHERS}) = 0 then any_value(value) else least(greatest(any_value(value), min({_OTHERS})), max({_OTHERS})) end"))
put("edge_preserving_mean_filter", lambda s, d: im.edge_preserving_mean_filter(fx.n(s, d), 5, 1.0), _window_sql("avg(other) filter (abs(other - value) < 1)", 2))
put("k_nearest_mean_filter", lambda s, d: im.k_nearest_mean_filter(fx.n(s, d), 3, 4), with_sql("select row, col, round(avg(other), 6) + 0.0 as value from (select *, row_number() over (partition by row, col order by abs(other - value) nulls last, dr, dc) as rn from w where value is not null) where rn <= 4 group by row, col union all select row, col, null from n where value is null", _w(1)))
put("lee_sigma_filter", lambda s, d: im.lee_sigma_filter(fx.n(s, d), 3, 0.5, 2), _window_sql("case when count(*) filter (abs(other - value) <= 0.5) > 2 then avg(other) filter (abs(other - value) <= 0.5) else coalesce(avg(other) filter (dr <> 0 or dc <> 0), any_value(value)) end"))
put("corner_detection", lambda s, d: im.corner_detection(fx.i(s, d)))
put("thicken_raster_line", lambda s, d: im.thicken_raster_line(fx.i(s, d)))
put("line_thinning", lambda s, d: im.line_thinning(fx.e(s, d).withColumn("value", (F.col("value") > 0.3).cast("double"))))
put("remove_spurs", lambda s, d: im.remove_spurs(fx.e(s, d).withColumn("value", (F.col("value") > 0.3).cast("double")), 2))

_D = tr.derivative_weights()
_PQ = "d as (select row, col, " + ", ".join(f"case when any_value(value) is not null then {_kernel(v.reshape(5, 5))} end as {k}" for k, v in _D.items()) + " from w group by row, col)"


def _derived(text: str, digits: int = 6) -> str:
    return with_sql(f"select row, col, round((case when p is not null then {text} end)::double, {digits}) + 0.0 as value from d", _w(2), _PQ)


for _name, _text in tr.CURVATURES.items():
    put(f"terrain_{_name}", (lambda t: lambda s, d: tr._expr(fx.n(s, d), t, 1.0, 1.0))(_text), _derived(_text, 5), 5)
for _name, _text in tr.SLOPES.items():
    put(f"slope_{_name}", (lambda u: lambda s, d: tr.slope(fx.n(s, d), u))(_name), _derived(_text))
put("aspect", lambda s, d: tr.aspect(fx.n(s, d)), _derived(tr.ASPECT, 5), 5)
put("hillshade", lambda s, d: tr.hillshade(fx.n(s, d)), _derived(tr.hillshade_text()))
put("multidirectional_hillshade", lambda s, d: tr.multidirectional_hillshade(fx.n(s, d)), _derived(" + ".join(f"{w} * {tr.hillshade_text(a, 45.0)}" for a, w in {225.0: 0.1, 270.0: 0.4, 315.0: 0.4, 360.0: 0.1}.items()), 3), 3)
put("standard_deviation_of_slope", lambda s, d: tr.standard_deviation_of_slope(fx.n(s, d), 3))
put("circular_variance_of_aspect", lambda s, d: tr.circular_variance_of_aspect(fx.n(s, d), 3))
put("diff_from_mean_elev", lambda s, d: tr.diff_from_mean_elev(fx.n(s, d), 5), _window_sql(f"any_value(value) - {_MEAN}", 2))
put("dev_from_mean_elev", lambda s, d: tr.dev_from_mean_elev(fx.e(s, d), 5), _window_sql(f"case when {_SD} > 1e-6 then (any_value(value) - {_MEAN}) / {_SD} else 0 end", 2, "e").replace("::double, 6)", "::double, 5)"), 5)
put("percent_elev_range", lambda s, d: tr.percent_elev_range(fx.n(s, d), 5), _window_sql("case when max(other) > min(other) then 100 * (any_value(value) - min(other)) / (max(other) - min(other)) else 0 end", 2))
put("relative_topographic_position", lambda s, d: tr.relative_topographic_position(fx.e(s, d), 5), _window_sql(f"coalesce(case when any_value(value) < {_MEAN} then (any_value(value) - {_MEAN}) / nullif({_MEAN} - min(other), 0) else (any_value(value) - {_MEAN}) / nullif(max(other) - {_MEAN}, 0) end, 0)", 2, "e"))
put("max_elevation_deviation", lambda s, d: tr.max_elevation_deviation(fx.n(s, d), 1, 3))
put("max_difference_from_mean", lambda s, d: tr.max_difference_from_mean(fx.n(s, d), 1, 3))
put("max_elev_dev_signature", lambda s, d: tr.max_elev_dev_signature(fx.n(s, d), fx.e(s, d).where("value > 2.5").select("row", "col", (F.col("row") * 64 + F.col("col")).cast("long").alias("id")), [1, 2]))
_NBR = "other) filter (dr <> 0 or dc <> 0"
put("num_downslope_neighbours", lambda s, d: tr.ring("NumDownslopeNeighbours", fx.n(s, d)), _window_sql("count(*) filter (other < value)"))
put("num_upslope_neighbours", lambda s, d: tr.ring("NumUpslopeNeighbours", fx.n(s, d)), _window_sql("count(*) filter (other > value)"))
put("max_downslope_elev_change", lambda s, d: tr.ring("MaxDownslopeElevChange", fx.n(s, d)), _window_sql("greatest(max(value - other), 0)"))
put("max_upslope_elev_change", lambda s, d: tr.ring("MaxUpslopeElevChange", fx.n(s, d)), _window_sql("greatest(max(other - value), 0)"))
put("min_downslope_elev_change", lambda s, d: tr.ring("MinDownslopeElevChange", fx.n(s, d)), _window_sql("min(value - other) filter (other < value)"))
put("ruggedness_index", lambda s, d: tr.ring("RuggednessIndex", fx.n(s, d)), _window_sql("coalesce(sqrt(avg((other - value) * (other - value)) filter (dr <> 0 or dc <> 0)), 0)"))
put("find_no_flow_cells", lambda s, d: tr.ring("FindNoFlowCells", fx.n(s, d)), _window_sql("case when count(*) filter (other < value) = 0 then 1 end"))
put("fill_single_cell_pits", lambda s, d: tr.ring("FillSingleCellPits", fx.n(s, d)), _window_sql(f"case when count(*) filter (other > value) = 8 then min({_NBR}) + 0.0001 else any_value(value) end"))
put("fd8_pointer", lambda s, d: tr.ring("FD8Pointer", fx.n(s, d)), _window_sql("coalesce(sum(case when other < value then case dr * 10 + dc when -9 then 1 when 1 then 2 when 11 then 4 when 10 then 8 when 9 then 16 when -1 then 32 when -11 then 64 when -10 then 128 end end), 0)"))
_EDGE = "case when any_value(value) > 0 then case when count(*) filter ((dr <> 0 or dc <> 0) and other is distinct from value) > 0 then any_value(value) else 0 end end"
put("find_patch_or_class_edge_cells", lambda s, d: tr.ring("FindPatchOrClassEdgeCells", fx.i(s, d)), _window_sql(_EDGE, 1, "i"))
put("edge_proportion", lambda s, d: tr.edge_proportion(fx.i(s, d)), with_sql("select class, round(avg((edge <> 0)::int), 6) as edge_proportion from (select any_value(value) as class, " + _EDGE + " as edge from w group by row, col) where edge is not null group by class", _w(1, "i")))
put("find_ridges", lambda s, d: tr.find_ridges(fx.n(s, d)), _window_sql("(count(*) filter (dc = 0 and dr <> 0 and other < value) = 2 or count(*) filter (dr = 0 and dc <> 0 and other < value) = 2)::int"))
put("elev_percentile", lambda s, d: tr.elev_percentile(fx.n(s, d), 3), _window_sql("100.0 * count(*) filter (floor(other * 100) < floor(value * 100)) / count(other)"))
put("spherical_std_dev_of_normals", lambda s, d: tr.spherical_std_dev_of_normals(fx.e(s, d), 3))
put("average_normal_vector_angular_deviation", lambda s, d: tr.average_normal_vector_angular_deviation(fx.e(s, d), 3))
put("surface_area_ratio", lambda s, d: tr.surface_area_ratio(fx.e(s, d)))
put("directional_relief", lambda s, d: tr.directional_relief(fx.n(s, d), 90.0, 5), with_sql("select a.row, a.col, round(avg(b.value) - any_value(a.value), 6) + 0.0 as value from n a left join n b on b.row = a.row and b.col between a.col + 1 and a.col + 5 group by a.row, a.col"))
put("horizon_angle", lambda s, d: tr.horizon_angle(fx.e(s, d), 180.0, 4), with_sql("select a.row, a.col, round(coalesce(degrees(atan(max((b.value - a.value) / (b.row - a.row)))), -90), 6) + 0.0 as value from e a left join e b on b.col = a.col and b.row between a.row + 1 and a.row + 4 group by a.row, a.col"))
put("fetch_analysis", lambda s, d: tr.fetch_analysis(fx.e(s, d), 0.0, 0.05, 6), with_sql("select a.row, a.col, coalesce(min(a.row - b.row) filter (b.value >= a.value + 0.05 * (a.row - b.row)), -coalesce(max(a.row - b.row), 0))::double + 0.0 as value from e a left join e b on b.col = a.col and b.row between a.row - 6 and a.row - 1 group by a.row, a.col"))
put("geomorphons", lambda s, d: tr.geomorphons(fx.e(s, d), 4))
put("pennock_landform_class", lambda s, d: tr.pennock_landform_class(fx.e(s, d)))
