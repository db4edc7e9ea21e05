"""Queries of the zonal, global and inferential statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import stats as st
from .base import cell_sql, put, with_sql

_ZONAL = "select zone, count(value) as n, round(avg(value), 6) + 0.0 as mean, round(median(value), 6) + 0.0 as median, round(min(value), 6) + 0.0 as minimum, round(max(value), 6) + 0.0 as maximum, round(max(value) - min(value), 6) + 0.0 as range, round(stddev_samp(value), 6) + 0.0 as standarddeviation, round(sum(value), 6) + 0.0 as total from n join z using (row, col) where value is not null group by zone"
put("zonal_statistics", lambda s, d: st.zonal_statistics(fx.n(s, d), fx.z(s, d)), with_sql(_ZONAL))
put("zonal_statistics_zero_background", lambda s, d: st.zonal_statistics(fx.n(s, d), fx.z(s, d), True), with_sql(_ZONAL.replace("is not null", "is not null and zone <> 0")))
put("raster_summary_stats", lambda s, d: st.raster_summary_stats(fx.n(s, d)), with_sql("select count(value) as n, round(min(value), 6) as minimum, round(max(value), 6) as maximum, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as stddev, round(sum(value), 6) as total from n"))
put("z_scores", lambda s, d: st.z_scores(fx.n(s, d)), with_sql("select row, col, round((value - mean) / sd, 6) + 0.0 as value from n, (select avg(value) as mean, stddev_pop(value) as sd from n)"))
put("cross_tabulation", lambda s, d: st.cross_tabulation(fx.i(s, d), fx.j(s, d)), with_sql("select i.value as class1, j.value as class2, count(*) as n from i join j using (row, col) where i.value is not null and j.value is not null group by 1, 2"))
put("kappa_index", lambda s, d: st.kappa_index(fx.i(s, d), fx.j(s, d)), with_sql("select tot::bigint as n, round(agree / tot, 6) as accuracy, round((agree - ch / tot) / (tot - ch / tot), 6) + 0.0 as kappa from (select sum(n) as tot, sum(case when a = b then n else 0 end) as agree from x), (select sum(r * c)::double as ch from (select a as k, sum(n) as r from x group by 1) join (select b as k, sum(n) as c from x group by 1) using (k))", "x as (select i.value as a, j.value as b, count(*) as n from i join j using (row, col) where i.value is not null and j.value is not null group by 1, 2)"))
put("image_correlation", lambda s, d: st.image_correlation(fx.n(s, d), fx.k(s, d)), with_sql("select count(*) as n, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) + 0.0 as r from (select n.value - (select avg(value) from n) as a, k.value - (select avg(value) from k) as b from n join k using (row, col) where n.value is not null and k.value is not null)"))
put("image_regression", lambda s, d: st.image_regression(fx.n(s, d), fx.e(s, d)), with_sql("select count(*) as n, round(regr_slope(b, a), 6) + 0.0 as slope, round(regr_intercept(b, a), 6) + 0.0 as intercept, round(corr(a, b), 6) + 0.0 as r, round(regr_r2(b, a), 6) + 0.0 as r_squared from (select n.value as a, e.value as b from n join e using (row, col) where n.value is not null)"))
put("root_mean_square_error", lambda s, d: st.root_mean_square_error(fx.n(s, d), fx.k(s, d)), with_sql("select count(*) as n, round(avg(b - a), 6) + 0.0 as mean_error, round(sqrt(avg((b - a) * (b - a))), 6) as rmse, round(avg(abs(b - a)), 6) as mean_absolute from (select n.value as a, k.value as b from n join k using (row, col) where n.value is not null and k.value is not null)"))


def _bins(bins: int, source: str = "n") -> str:
    return f"h as (select row, col, value, least(coalesce(floor((value - lo) / nullif(hi - lo, 0) * {bins}), 0), {bins - 1})::int as bin from {source}, (select min(value) as lo, max(value) as hi from {source}) where value is not null)"


put("raster_histogram", lambda s, d: st.raster_histogram(fx.n(s, d), 50), with_sql("select bin, count(*) as n from h group by bin", _bins(50)))
_CDF = "c as (select bin, sum(n) over (order by bin) / sum(n) over () as share from (select bin, count(*) as n from h group by bin))"
put("cumulative_distribution", lambda s, d: st.cumulative_distribution(fx.n(s, d)), with_sql("select row, col, round(share, 6) as value from h join c using (bin)", _bins(50000), _CDF))
put("quantiles", lambda s, d: st.quantiles(fx.n(s, d), 5), with_sql("select row, col, least(floor(share * 5) + 1, 5)::double as value from h join c using (bin)", _bins(10000), _CDF))
put("histogram_equalization", lambda s, d: st.histogram_equalization(fx.n(s, d)), with_sql("select row, col, least(floor(share * 256), 255)::double as value from h join c using (bin)", _bins(10000), _CDF))
put("list_unique_values", lambda s, d: st.list_unique_values(fx.table(s, d, "customer"), "c_mktsegment"), "select c_mktsegment::varchar as category, count(*) as frequency from customer group by 1")
put("list_unique_values_raster", lambda s, d: st.list_unique_values_raster(fx.n(s, d)), with_sql("select trunc(value)::bigint as category, count(*) as frequency from n where value is not null group by 1"))
put("crispness_index", lambda s, d: st.crispness_index(fx.n(s, d).withColumn("value", F.abs("value") / 10)), with_sql("select round(ss / (s * (1 - mean) ** 2 + (n - s) * mean ** 2), 6) as crispness from (select sum(v) as s, avg(v) as mean, count(v) as n, var_pop(v) * count(v) as ss from (select abs(value) / 10 as v from n where value is not null))"))
put("anova", lambda s, d: st.anova(fx.n(s, d), fx.z(s, d)), with_sql("select round(sum(n * (mean - grand) ** 2), 6) as ss_between, round(sum(w), 6) as ss_within, count(*) - 1 as df_between, (sum(n) - count(*))::bigint as df_within, round((sum(n * (mean - grand) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) as f from (select count(*) as n, avg(value) as mean, var_pop(value) * count(*) as w from n join z using (row, col) where value is not null group by zone), (select avg(value) as grand from n)"))
put("paired_sample_t_test", lambda s, d: st.paired_sample_t_test(fx.n(s, d), fx.k(s, d)), with_sql("select count(*) as n, round(avg(x), 6) + 0.0 as mean, round(stddev_pop(x), 6) as stddev, round(avg(x) / (stddev_pop(x) / sqrt(count(*))), 6) + 0.0 as t from (select k.value - n.value as x from n join k using (row, col) where n.value is not null and k.value is not null)"))
put("two_sample_ks_test", lambda s, d: st.two_sample_ks_test(fx.n(s, d), fx.i(s, d)).select("n1", "n2", "d"), with_sql("select max(n1)::bigint as n1, max(n2)::bigint as n2, round(max(abs(ca / n1 - cb / n2)), 6) as d from (select sum(a) over (order by value) as ca, sum(b) over (order by value) as cb, sum(a) over () as n1, sum(b) over () as n2 from (select value, sum(a) as a, sum(b) as b from (select value, 1 as a, 0 as b from n where value is not null union all select value, 0, 1 from i where value is not null) group by value))"))
put("ks_test_for_normality", lambda s, d: st.ks_test_for_normality(fx.n(s, d)), None)
put("wilcoxon_signed_rank_test", lambda s, d: st.wilcoxon_signed_rank_test(fx.i(s, d), fx.j(s, d)), with_sql("select n, round(w, 6) + 0.0 as w, round(w / sqrt(n * (n + 1.0) * (2 * n + 1) / 6), 6) + 0.0 as z from (select count(*) as n, sum(rk * sign(x)) as w from (select x, rank() over (order by abs(x)) + (count(*) over (partition by abs(x)) - 1) / 2.0 as rk from (select j.value - i.value as x from i join j using (row, col) where i.value is not null and j.value is not null) where x <> 0))"))
for _name, _test in (("rook", "abs(b.row - a.row) + abs(b.col - a.col) = 1"), ("king", "greatest(abs(b.row - a.row), abs(b.col - a.col)) = 1")):
    put(f"image_autocorrelation_{_name}", (lambda c: lambda s, d: st.image_autocorrelation(fx.n(s, d), c))(_name), with_sql(f"select any_value(g.c) as n, count(*) as w, round(any_value(g.c) / count(*) * sum((a.value - g.mean) * (b.value - g.mean)) / any_value(g.ss), 6) + 0.0 as moran_i from n a join n b on b.row between a.row - 1 and a.row + 1 and b.col between a.col - 1 and a.col + 1 and {_test}, (select avg(value) as mean, count(value) as c, var_pop(value) * count(value) as ss from n) g where a.value is not null and b.value is not null"))
put("trend_surface", lambda s, d: st.trend_surface(fx.n(s, d), 2))
put("principal_component_analysis", lambda s, d: st.principal_component_analysis([fx.n(s, d), fx.m(s, d), fx.k(s, d)]))
put("k_means_clustering", lambda s, d: st.k_means_clustering([fx.n(s, d), fx.k(s, d)], 4))
put("rescale_value_range", lambda s, d: st.rescale_value_range(fx.n(s, d), 0, 100, -1, 1), cell_sql("case when value is not null then (least(greatest(value, -1), 1) + 1) / 2 * 100 end from n"))
put("min_max_contrast_stretch", lambda s, d: st.min_max_contrast_stretch(fx.n(s, d), -1, 1), cell_sql("case when value is not null then greatest(0, least(255, floor((value + 1) / 2 * 256))) end from n"))
put("standard_deviation_contrast_stretch", lambda s, d: st.standard_deviation_contrast_stretch(fx.n(s, d)), with_sql("select row, col, case when value is not null then greatest(0, least(255, floor((value - (mean - 2 * sd)) / (4 * sd) * 256))) end::double as value from n, (select avg(value) as mean, stddev_pop(value) as sd from n)"))
put("percentage_contrast_stretch", lambda s, d: st.percentage_contrast_stretch(fx.n(s, d), 2.0), with_sql("select row, col, case when value is not null then greatest(0, least(255, floor((value - lo) / (hi - lo) * 256))) end::double as value from n, (select quantile_cont(value, 0.02) as lo, quantile_cont(value, 0.98) as hi from n)"))
put("sigmoidal_contrast_stretch", lambda s, d: st.sigmoidal_contrast_stretch(fx.n(s, d), 0.5, 4.0), with_sql("select row, col, floor((1 / (1 + exp(4 * (0.5 - (value - lo) / (hi - lo)))) - a) / b * 255)::double as value from n, (select min(value) as lo, max(value) as hi, 1 / (1 + exp(2.0)) as a, 1 / (1 + exp(-2.0)) - 1 / (1 + exp(2.0)) as b from n)"))
put("otsu_thresholding", lambda s, d: st.otsu_thresholding(fx.n(s, d)))
put("raster_area", lambda s, d: st.raster_area(fx.i(s, d), 2.5, True), with_sql("select value as class, count(*) as n, count(*) * 2.5::double as area from i where value is not null and value <> 0 group by value"))
put("centroid", lambda s, d: st.centroid(fx.z(s, d)), with_sql("select zone as class, round(avg(row), 6) as mean_row, round(avg(col), 6) as mean_col from z where zone > 0 group by zone"))
put("radius_of_gyration", lambda s, d: st.radius_of_gyration(fx.z(s, d), 2.0), with_sql("select zone as class, round(sqrt(var_pop(row) + var_pop(col)) * 2, 6) as gyration from z where zone > 0 group by zone"))
put("filter_raster_features_by_area", lambda s, d: st.filter_raster_features_by_area(fx.i(s, d), 500), with_sql("select row, col, case when c < 500 then 0 else value end + 0.0::double as value from (select *, count(value) over (partition by value) as c from i) where value is not null union all select row, col, null from i where value is null"))
put("elev_relative_to_min_max", lambda s, d: st.elev_relative_to_min_max(fx.n(s, d)), with_sql("select row, col, round(100 * (value - lo) / (hi - lo), 6) as value from n, (select min(value) as lo, max(value) as hi from n)"))
put("elev_relative_to_watershed_min_max", lambda s, d: st.elev_relative_to_watershed_min_max(fx.n(s, d), fx.z(s, d)), with_sql("select row, col, round(100 * (value - min(value) over (partition by zone)) / (max(value) over (partition by zone) - min(value) over (partition by zone)), 6) as value from n join z using (row, col) where value is not null"))
put("hypsometric_analysis", lambda s, d: st.hypsometric_analysis(fx.n(s, d), 40), with_sql("select bin, round(sum(n) over (order by bin desc) / sum(n) over (), 6) as share_above from (select bin, count(*) as n from h group by bin)", _bins(40)))
put("slope_vs_elevation_plot", lambda s, d: st.slope_vs_elevation_plot(fx.n(s, d), fx.e(s, d), 20), with_sql("select bin, round(avg(e.value), 6) + 0.0 as mean_slope from h join e using (row, col) group by bin", _bins(20)))
put("find_lowest_points", lambda s, d: st.find_lowest_or_highest_points(fx.n(s, d)), with_sql("select row, col, round(value, 6) as value from n where value is not null order by value, row, col limit 1"))
put("find_highest_points", lambda s, d: st.find_lowest_or_highest_points(fx.n(s, d), "highest"), with_sql("select row, col, round(value, 6) as value from n where value is not null order by value desc, row, col limit 1"))
put("random_field", lambda s, d: st.random_field(fx.e(s, d), 7))
put("random_sample", lambda s, d: st.random_sample(fx.e(s, d), 100, 7))
put("attribute_correlation", lambda s, d: st.attribute_correlation(fx.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "select 'l_quantity' as field1, 'l_quantity' as field2, round(corr(l_quantity, l_quantity), 6) as r from lineitem union all select 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) + 0.0 from lineitem union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) + 0.0 from lineitem union all select 'l_extendedprice', 'l_extendedprice', round(corr(l_extendedprice, l_extendedprice), 6) from lineitem union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) + 0.0 from lineitem union all select 'l_discount', 'l_discount', round(corr(l_discount, l_discount), 6) from lineitem")
put("attribute_histogram", lambda s, d: st.attribute_histogram(fx.table(s, d, "part"), "p_retailprice", 20), "select least(floor((p_retailprice::double - lo) / nullif(hi - lo, 0) * 20), 19)::int as bin, count(*) as n from part, (select min(p_retailprice)::double as lo, max(p_retailprice)::double as hi from part) group by 1")
put("attribute_scattergram", lambda s, d: st.attribute_scattergram(fx.table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), "select count(*) as n, round(regr_slope(l_extendedprice::double, l_quantity::double), 6) as slope, round(regr_intercept(l_extendedprice::double, l_quantity::double), 6) + 0.0 as intercept, round(regr_r2(l_extendedprice::double, l_quantity::double), 6) as r_squared from lineitem")
