"""Zonal, global and inferential statistics of cell tables.

Statistics of a whole raster are one row, joined by broadcast; of zones, one row a zone, aggregated before
the shuffle.  Histogram methods keep as many rows as there are bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..registry import register, tool

MATH = "Math and Stats"
GIS = "GIS Analysis"
IMAGE = "Image Processing"
TERRAIN = "Geomorphometric Analysis"
KEY = ["row", "col"]


def paired(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two rasters side by side, where both have data."""
    both = a.select(*KEY, F.col("value").alias(names[0])).join(b.select(*KEY, F.col("value").alias(names[1])), KEY)
    return both.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull())


def with_stats(cells: DataFrame, **stats: Column) -> DataFrame:
    """The cells with statistics of the whole raster as columns: one broadcast row."""
    one = cells.agg(*[c.alias(n) for n, c in stats.items()])
    return cells.join(F.broadcast(one))


@tool("ZonalStatistics", MATH)
def zonal_statistics(cells: DataFrame, zones: DataFrame, zero_is_background: bool = False) -> DataFrame:
    """Mean, median, minimum, maximum, range, standard deviation and total of each zone.

    Zones are rounded; a zone of one cell has a median and a standard deviation of 0.
    """
    both = paired(cells, zones, ("value", "zone")).withColumn("zone", F.round("zone"))
    if zero_is_background:
        both = both.where("zone <> 0")
    one = F.count("value") == 1
    return both.groupBy("zone").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.when(one, 0.0).otherwise(F.percentile("value", F.lit(0.5))).alias("median"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        (F.max("value") - F.min("value")).alias("range"),
        F.when(one, 0.0).otherwise(F.stddev_samp("value")).alias("standarddeviation"),
        F.sum("value").alias("total"),
    )


@tool("RasterSummaryStats", MATH)
def raster_summary_stats(cells: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, population standard deviation, number and total of the cells with data."""
    return cells.agg(F.count("value").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), F.sum("value").alias("total"))


@tool("ZScores", MATH)
def z_scores(cells: DataFrame) -> DataFrame:
    """Values standardised by the mean and the population standard deviation."""
    out = with_stats(cells, mean=F.avg("value"), sd=F.stddev_pop("value"))
    return out.select(*KEY, ((F.col("value") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("value"))


@tool("CrossTabulation", MATH)
def cross_tabulation(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many cells each pair of rounded classes has, as class1, class2, n."""
    return paired(a, b).groupBy(F.round("a").alias("class1"), F.round("b").alias("class2")).agg(F.count("*").alias("n"))


@tool("KappaIndex", MATH)
def kappa_index(classified: DataFrame, reference: DataFrame) -> DataFrame:
    """Overall accuracy and Cohen's kappa of two categorical rasters."""
    matrix = cross_tabulation(classified, reference)
    total = matrix.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("class1") == F.col("class2"), F.col("n")).otherwise(0)).alias("agree"))
    rows = matrix.groupBy(F.col("class1").alias("class")).agg(F.sum("n").alias("r"))
    cols = matrix.groupBy(F.col("class2").alias("class")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "class").agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("products"))
    out = total.join(F.broadcast(chance))
    expected = F.coalesce("products", F.lit(0.0)) / F.col("total")
    return out.select(F.col("total").alias("n"), (F.col("agree") / F.col("total")).alias("accuracy"), ((F.col("agree") - expected) / F.nullif(F.col("total") - expected, F.lit(0.0))).alias("kappa"))


@tool("ImageCorrelation", MATH)
def image_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson's r of two rasters, each with the mean of all its own cells."""
    left, right = with_stats(a, mean_a=F.avg("value")), with_stats(b, mean_b=F.avg("value"))
    both = left.select(*KEY, (F.col("value") - F.col("mean_a")).alias("a")).join(right.select(*KEY, (F.col("value") - F.col("mean_b")).alias("b")), KEY).where("a is not null and b is not null")
    return both.agg(F.count("*").alias("n"), (F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))).alias("r"))


@tool("ImageRegression", MATH)
def image_regression(x: DataFrame, y: DataFrame) -> DataFrame:
    """Slope, intercept, r and r squared of the second raster on the first."""
    return paired(x, y).agg(F.count("*").alias("n"), F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"), F.corr("a", "b").alias("r"), F.regr_r2("b", "a").alias("r_squared"))


@tool("RootMeanSquareError", MATH)
def root_mean_square_error(cells: DataFrame, base: DataFrame) -> DataFrame:
    """RMSE, mean vertical error and mean absolute error of a raster against a base."""
    d = F.col("b") - F.col("a")
    return paired(cells, base).agg(F.count("*").alias("n"), F.avg(d).alias("mean_error"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mean_absolute"))


def _binned(cells: DataFrame, bins: int) -> DataFrame:
    out = with_stats(cells, lo=F.min("value"), hi=F.max("value"))
    at = F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    return out.withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")).where("value is not null")


@tool("RasterHistogram", MATH)
def raster_histogram(cells: DataFrame, bins: int = 100) -> DataFrame:
    """Counts of equal-width bins from the minimum to the maximum; empty bins are left out."""
    return _binned(cells, bins).groupBy("bin").agg(F.count("*").alias("n"))


@tool("CumulativeDistribution", MATH)
def cumulative_distribution(cells: DataFrame, bins: int = 50_000) -> DataFrame:
    """Each cell's share of cells in its bin or lower ones."""
    binned = _binned(cells, bins)
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))  # a row a bin
    share = F.sum("n").over(W.orderBy("bin")) / F.sum("n").over(W.partitionBy())
    return binned.join(F.broadcast(counts.select("bin", share.alias("share"))), "bin").select(*KEY, F.col("share").alias("value"))


@tool("Quantiles", MATH)
def quantiles(cells: DataFrame, num_quantiles: int = 5, bins: int = 10_000) -> DataFrame:
    """The quantile class, from 1, of each cell, by a histogram's cumulative distribution."""
    shares = cumulative_distribution(cells, bins)
    return shares.withColumn("value", F.least(F.floor(F.col("value") * num_quantiles) + 1, F.lit(num_quantiles)).cast("double"))


@tool("HistogramEqualization", IMAGE)
def histogram_equalization(cells: DataFrame, num_tones: int = 256) -> DataFrame:
    """Tones by the cumulative distribution."""
    shares = cumulative_distribution(cells, 10_000)
    return shares.withColumn("value", F.least(F.floor(F.col("value") * num_tones), F.lit(num_tones - 1)).cast("double"))


@tool("ListUniqueValues", MATH)
def list_unique_values(table: DataFrame, field: str) -> DataFrame:
    """The values of an attribute and how often each occurs."""
    return table.groupBy(F.col(field).cast("string").alias("category")).agg(F.count("*").alias("frequency"))


@tool("ListUniqueValuesRaster", MATH)
def list_unique_values_raster(cells: DataFrame) -> DataFrame:
    """Truncated values and how often each occurs."""
    return cells.where(F.col("value").isNotNull()).groupBy(F.col("value").cast("long").alias("category")).agg(F.count("*").alias("frequency"))


@tool("CrispnessIndex", MATH)
def crispness_index(cells: DataFrame) -> DataFrame:
    """How crisp a probability raster is: 1 if all cells are 0 or 1, 0 if all are alike."""
    out = cells.where(F.col("value").isNotNull()).agg(F.sum("value").alias("s"), F.avg("value").alias("mean"), F.count("value").alias("n"), (F.var_pop("value") * F.count("value")).alias("ss"))
    sharp = F.col("s") * F.pow(1 - F.col("mean"), 2) + (F.col("n") - F.col("s")) * F.pow("mean", 2)
    return out.select(F.when(sharp != 0, F.col("ss") / sharp).otherwise(0.0).alias("crispness"))


@tool("Anova", MATH)
def anova(cells: DataFrame, features: DataFrame) -> DataFrame:
    """Sums of squares between and within classes, their degrees of freedom, and F."""
    groups = paired(cells, features, ("value", "class")).groupBy(F.round("class").alias("class")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("within"))
    out = groups.join(F.broadcast(groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))))
    out = out.agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ss_between"), F.sum("within").alias("ss_within"), (F.count("*") - 1).alias("df_between"), (F.sum("n") - F.count("*")).alias("df_within"))
    return out.withColumn("f", (F.col("ss_between") / F.col("df_between")) / (F.col("ss_within") / F.col("df_within")))


@tool("PairedSampleTTest", MATH)
def paired_sample_t_test(a: DataFrame, b: DataFrame) -> DataFrame:
    """t of the differences, by the population variance."""
    d = F.col("b") - F.col("a")
    return paired(a, b).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("stddev"), (F.avg(d) / (F.stddev_pop(d) / F.sqrt(F.count("*")))).alias("t"))


def _running_share(values: DataFrame, weights: list[str]) -> DataFrame:
    """Cumulative sums over distinct values, in two levels: blocks of values, then the blocks."""
    n = max(2, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = values.agg(F.percentile_approx("value", F.lit([i / n for i in range(1, n)]), F.lit(10_000)).alias("cuts"))
    blocked = values.join(F.broadcast(bounds)).withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    totals = blocked.groupBy("block").agg(*[F.sum(c).alias(f"t_{c}") for c in weights])
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("block", *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"o_{c}") for c in weights])
    within = W.partitionBy("block").orderBy("value")
    out = blocked.join(F.broadcast(offsets), "block")  # as many rows as partitions
    return out.select("value", *weights, *[(F.sum(c).over(within) + F.col(f"o_{c}")).alias(f"c_{c}") for c in weights])


@tool("TwoSampleKsTest", MATH)
def two_sample_ks_test(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of two cumulative distributions, with the sizes and an asymptotic p."""
    union = a.where(F.col("value").isNotNull()).select("value", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.where(F.col("value").isNotNull()).select("value", F.lit(0), F.lit(1)))
    counts = union.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = _running_share(counts, ["a", "b"])
    sizes = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    out = run.join(F.broadcast(sizes)).agg(F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.abs(F.col("c_a") / F.col("n1") - F.col("c_b") / F.col("n2"))).alias("d"))
    root = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    x = (root + 0.12 + 0.11 / root) * F.col("d")
    tail = sum((2.0 * (-1) ** (i - 1) * F.exp(-2.0 * i * i * x * x) for i in range(1, 21)), F.lit(0.0))
    return out.withColumn("p", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0))))


@tool("KsTestForNormality", MATH)
def ks_test_for_normality(cells: DataFrame) -> DataFrame:
    """Largest difference between the cumulative distribution and a normal one of equal mean and deviation."""
    own = cells.where(F.col("value").isNotNull())
    counts = own.groupBy("value").agg(F.count("*").alias("a"))
    stats = own.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    run = _running_share(counts, ["a"]).join(F.broadcast(stats))
    # erf by Abramowitz and Stegun 7.1.26, to 1.5e-7
    x = (F.col("value") - F.col("mean")) / (F.col("sd") * math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    cdf = (1.0 + F.signum(x) * (1.0 - poly * F.exp(-x * x))) / 2.0
    return run.agg(F.first("n").alias("n"), F.max(F.greatest(F.abs(F.col("c_a") / F.col("n") - cdf), F.abs((F.col("c_a") - F.col("a")) / F.col("n") - cdf))).alias("d"))


@tool("WilcoxonSignedRankTest", MATH)
def wilcoxon_signed_rank_test(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of signed ranks of the non-zero differences, and z; ties share their mean rank."""
    d = paired(a, b).select((F.col("b") - F.col("a")).alias("d")).where("d <> 0")
    counts = d.groupBy(F.abs("d").alias("value")).agg(F.count("*").alias("n"), F.sum(F.signum("d")).alias("sign"))
    run = _running_share(counts, ["n"]).select("value", "c_n", "n")
    ranks = run.select("value", (F.col("c_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    out = counts.join(ranks, "value").agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("sign")).alias("w"))
    n = F.col("n").cast("double")
    return out.withColumn("z", F.col("w") / F.sqrt(n * (n + 1) * (2 * n + 1) / 6))


@tool("ImageAutocorrelation", MATH)
def image_autocorrelation(cells: DataFrame, contiguity: str = "rook") -> DataFrame:
    """Moran's I over rook, bishop or king neighbours."""
    from ..plans.focal import neighbours

    rook, bishop = [(-1, 0), (1, 0), (0, -1), (0, 1)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    offsets = {"rook": rook, "bishop": bishop, "king": rook + bishop}[contiguity.lower()]
    one = cells.agg(F.avg("value").alias("mean"), F.count("value").alias("n"), (F.var_pop("value") * F.count("value")).alias("ss"))
    pairs = neighbours(cells, offsets).where("value is not null and other is not null").join(F.broadcast(one))
    return pairs.agg(F.first("n").alias("n"), F.count("*").alias("w"), (F.first("n") / F.count("*") * F.sum((F.col("value") - F.col("mean")) * (F.col("other") - F.col("mean"))) / F.first("ss")).alias("moran_i"))


@tool("TrendSurface", MATH)
def trend_surface(cells: DataFrame, order: int = 1) -> DataFrame:
    """The least-squares polynomial of a raster; only its normal equations reach the driver."""
    import numpy as np

    top = cells.agg(F.max("row"), F.max("col")).first()
    x = (F.col("col") / max(1, top[1] or 0)).cast("double")
    y = (F.col("row") / max(1, top[0] or 0)).cast("double")
    terms = [F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j))) for i in range(order + 1) for j in range(order + 1 - i)]
    n = len(terms)
    sums = cells.where(F.col("value").isNotNull()).agg(*[F.sum(terms[i] * terms[j]) for i in range(n) for j in range(n)], *[F.sum(t * F.col("value")) for t in terms]).first()
    if sums[0] is None:
        return cells
    a, b = np.array(sums[: n * n], float).reshape(n, n), np.array(sums[n * n :], float)
    coefficients = np.linalg.lstsq(a, b, rcond=None)[0]
    return cells.select(*KEY, sum((float(c) * t for c, t in zip(coefficients, terms, strict=True)), F.lit(0.0)).alias("value"))


@tool("PrincipalComponentAnalysis", MATH)
def principal_component_analysis(layers: list[DataFrame], standardized: bool = False) -> DataFrame:
    """Eigenvalues and eigenvectors of the layers' covariance (or correlation): component, eigenvalue, share, loadings."""
    import numpy as np

    joined = None
    for i, cells in enumerate(layers):
        own = cells.select(*KEY, F.col("value").alias(f"v{i}"))
        joined = own if joined is None else joined.join(own, KEY)
    k = len(layers)
    joined = joined.dropna()
    how = F.corr if standardized else F.covar_pop
    row = joined.agg(*[how(f"v{i}", f"v{j}") for i in range(k) for j in range(k)]).first()
    values, vectors = np.linalg.eigh(np.array(row, float).reshape(k, k))
    order = np.argsort(-values)
    rows = [(c + 1, float(values[i]), float(values[i] / values.sum()), [float(x * (1 if vectors[:, i].sum() >= 0 else -1)) for x in vectors[:, i]]) for c, i in enumerate(order)]
    return joined.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, loadings array<double>")


@tool("KMeansClustering", IMAGE)
def k_means_clustering(layers: list[DataFrame], classes: int, max_iterations: int = 10) -> DataFrame:
    """Classes from 1 by Lloyd's iterations from centres on the diagonal; only the centres reach the driver."""
    k = len(layers)
    joined = None
    for i, cells in enumerate(layers):
        own = cells.select(*KEY, F.col("value").alias(f"v{i}"))
        joined = own if joined is None else joined.join(own, KEY)
    known = joined.dropna()
    bounds = known.agg(*[f(f"v{i}") for i in range(k) for f in (F.min, F.max)]).first()
    centres = [[bounds[2 * i] + (bounds[2 * i + 1] - bounds[2 * i]) / classes * a for i in range(k)] for a in range(classes)]

    def nearest(centres: list[list[float]]) -> Column:
        d = [F.struct(sum((F.pow(F.col(f"v{i}") - c[i], 2.0) for i in range(k)), F.lit(0.0)).alias("d"), F.lit(n + 1).alias("n")) for n, c in enumerate(centres)]
        return F.least(*d)["n"] if len(d) > 1 else F.lit(1)

    for _ in range(max_iterations):
        rows = known.groupBy(nearest(centres).alias("n")).agg(*[F.avg(f"v{i}") for i in range(k)]).collect()  # a row a class
        new = [list(c) for c in centres]
        for r in rows:
            new[r["n"] - 1] = list(r)[1:]
        if new == centres:
            break
        centres = new
    return known.select(*KEY, nearest(centres).cast("double").alias("value"))


# -- contrast stretches ---------------------------------------------------------------------------------------


def _stretched(unit: Column, num_tones: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(num_tones - 1.0), F.floor(unit * num_tones).cast("double")))


@tool("RescaleValueRange", MATH)
def rescale_value_range(cells: DataFrame, out_min_val: float, out_max_val: float, clip_min: float | None = None, clip_max: float | None = None) -> DataFrame:
    """Values stretched linearly to a new range, clipped first if asked."""
    low = F.min("value") if clip_min is None else F.lit(float(clip_min))
    high = F.max("value") if clip_max is None else F.lit(float(clip_max))
    out = with_stats(cells, lo=low, hi=high)
    unit = (F.least(F.greatest(F.col("value"), F.col("lo")), F.col("hi")) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return out.select(*KEY, F.when(F.col("value").isNotNull(), out_min_val + unit * (out_max_val - out_min_val)).alias("value"))


@tool("MinMaxContrastStretch", IMAGE)
def min_max_contrast_stretch(cells: DataFrame, min_val: float, max_val: float, num_tones: int = 256) -> DataFrame:
    """Tones of a linear stretch between two values."""
    return cells.withColumn("value", F.when(F.col("value").isNotNull(), _stretched((F.col("value") - min_val) / (max_val - min_val), num_tones)))


@tool("StandardDeviationContrastStretch", IMAGE)
def standard_deviation_contrast_stretch(cells: DataFrame, stdev: float = 2.0, num_tones: int = 256) -> DataFrame:
    """Tones of a linear stretch over some standard deviations about the mean."""
    out = with_stats(cells, mean=F.avg("value"), sd=F.stddev_pop("value"))
    low, width = F.col("mean") - stdev * F.col("sd"), 2 * stdev * F.col("sd")
    return out.select(*KEY, F.when(F.col("value").isNotNull(), _stretched((F.col("value") - low) / width, num_tones)).alias("value"))


@tool("PercentageContrastStretch", IMAGE)
def percentage_contrast_stretch(cells: DataFrame, clip: float = 1.0, num_tones: int = 256) -> DataFrame:
    """Tones of a linear stretch between two percentiles."""
    out = with_stats(cells, lo=F.percentile("value", F.lit(clip / 100)), hi=F.percentile("value", F.lit(1 - clip / 100)))
    return out.select(*KEY, F.when(F.col("value").isNotNull(), _stretched((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), num_tones)).alias("value"))


@tool("SigmoidalContrastStretch", IMAGE)
def sigmoidal_contrast_stretch(cells: DataFrame, cutoff: float = 0.0, gain: float = 1.0, num_tones: int = 256) -> DataFrame:
    """Tones by a logistic curve between the minimum and the maximum."""
    out = with_stats(cells, lo=F.min("value"), hi=F.max("value"))
    unit = (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    a = 1 / (1 + math.exp(gain * cutoff))
    b = 1 / (1 + math.exp(gain * (cutoff - 1))) - a
    return out.select(*KEY, F.when(F.col("value").isNotNull(), F.floor((1 / (1 + F.exp(gain * (cutoff - unit))) - a) / b * (num_tones - 1)).cast("double")).alias("value"))


@tool("OtsuThresholding", "Plug-ins")
def otsu_thresholding(cells: DataFrame, bins: int = 256) -> DataFrame:
    """1 above the threshold of greatest between-class variance of a histogram, else 0."""
    counts = {r["bin"]: r["n"] for r in raster_histogram(cells, bins).collect()}  # a row a bin
    low, high = cells.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return cells
    total, weighted = sum(counts.values()), sum(b * n for b, n in counts.items())
    best, at, n, s = -1.0, 0, 0, 0
    for b in sorted(counts)[:-1]:
        n, s = n + counts[b], s + b * counts[b]
        between = n * (total - n) * (s / n - (weighted - s) / (total - n)) ** 2
        if between > best:
            best, at = between, b
    return cells.withColumn("value", (F.col("value") > low + (at + 1) * (high - low) / bins).cast("double"))


# -- patches and zones ------------------------------------------------------------------------------------------


@tool("RasterArea", GIS)
def raster_area(cells: DataFrame, cell_area: float = 1.0, zero_back: bool = False) -> DataFrame:
    """Number of cells and area of each class."""
    own = cells.where(F.col("value").isNotNull() & (F.col("value") != 0)) if zero_back else cells.where(F.col("value").isNotNull())
    return own.groupBy(F.round("value").alias("class")).agg(F.count("*").alias("n"), (F.count("*") * F.lit(float(cell_area))).alias("area"))


@tool("Centroid", GIS)
def centroid(cells: DataFrame) -> DataFrame:
    """Mean row and column of each patch of positive value."""
    return cells.where(F.col("value") > 0).groupBy(F.round("value").alias("class")).agg(F.avg("row").alias("mean_row"), F.avg("col").alias("mean_col"))


@tool("RadiusOfGyration", GIS)
def radius_of_gyration(cells: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Root mean square distance of each class's cells to its centroid."""
    var = F.var_pop("row") + F.var_pop("col")
    return cells.where(F.col("value") > 0).groupBy(F.round("value").alias("class")).agg((F.sqrt(var) * resolution).alias("gyration"))


@tool("FilterRasterFeaturesByArea", GIS)
def filter_raster_features_by_area(cells: DataFrame, threshold: int, background: float | None = 0.0) -> DataFrame:
    """Classes of fewer cells than the threshold become background."""
    sizes = cells.where(F.col("value").isNotNull()).groupBy(F.round("value").alias("class")).agg(F.count("*").alias("n"))
    out = cells.withColumn("class", F.round("value")).join(sizes, "class", "left")
    return out.select(*KEY, F.when(F.col("n") < threshold, F.lit(background).cast("double")).otherwise(F.col("value")).alias("value"))


@tool("ElevRelativeToMinMax", TERRAIN)
def elev_relative_to_min_max(cells: DataFrame) -> DataFrame:
    """Percentage of the raster's range at which a value lies."""
    out = with_stats(cells, lo=F.min("value"), hi=F.max("value"))
    return out.select(*KEY, (100 * (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("value"))


@tool("ElevRelativeToWatershedMinMax", TERRAIN)
def elev_relative_to_watershed_min_max(cells: DataFrame, watersheds: DataFrame) -> DataFrame:
    """Percentage of its watershed's range at which a value lies."""
    both = paired(cells, watersheds, ("value", "zone"))
    bounds = both.groupBy("zone").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = both.join(bounds, "zone")
    return out.select(*KEY, F.coalesce(100 * (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)).alias("value"))


@tool("HypsometricAnalysis", TERRAIN)
def hypsometric_analysis(cells: DataFrame, bins: int = 100) -> DataFrame:
    """Share of the area above the floor of each elevation bin."""
    counts = raster_histogram(cells, bins)
    above = F.sum("n").over(W.orderBy(F.desc("bin"))) / F.sum("n").over(W.partitionBy())
    return counts.select("bin", above.alias("share_above"))


@tool("SlopeVsElevationPlot", TERRAIN)
def slope_vs_elevation_plot(dem: DataFrame, slope: DataFrame, bins: int = 50) -> DataFrame:
    """Mean slope of each elevation bin."""
    binned = _binned(dem, bins).select(*KEY, "bin")
    return binned.join(slope.select(*KEY, "value"), KEY).groupBy("bin").agg(F.avg("value").alias("mean_slope"))


@tool("FindLowestOrHighestPoints", GIS)
def find_lowest_or_highest_points(cells: DataFrame, out_type: str = "lowest") -> DataFrame:
    """The cell of the lowest or highest value, the first by row and column on ties."""
    at = F.struct("row", "col")
    key = F.struct(F.col("value") if out_type == "lowest" else -F.col("value"), "row", "col")
    return cells.where(F.col("value").isNotNull()).agg(F.min_by(at, key).alias("at"), (F.min if out_type == "lowest" else F.max)("value").alias("value")).select("at.row", "at.col", "value")


@tool("RandomField", MATH)
def random_field(base: DataFrame, seed: int = 0) -> DataFrame:
    """A standard normal number for each cell, by its place and a seed."""
    unit = lambda s: (F.pmod(F.xxhash64("row", "col", F.lit(s)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return base.select(*KEY, (F.sqrt(-2 * F.ln(unit(2 * seed))) * F.cos(2 * math.pi * unit(2 * seed + 1))).alias("value"))


@tool("RandomSample", MATH)
def random_sample(base: DataFrame, num_samples: int = 1000, seed: int = 0) -> DataFrame:
    """Cells chosen at random, numbered from 1; the others are 0."""
    chosen = base.where(F.col("value").isNotNull()).select(*KEY, F.xxhash64("row", "col", F.lit(seed)).alias("h")).orderBy("h", *KEY).limit(num_samples)
    numbered = chosen.select(*KEY, F.row_number().over(W.orderBy("h", *KEY)).cast("double").alias("id"))  # as many rows as asked for
    return base.join(F.broadcast(numbered) if num_samples <= 100_000 else numbered, KEY, "left").select(*KEY, F.when(F.col("value").isNotNull(), F.coalesce("id", F.lit(0.0))).alias("value"))


@tool("AttributeCorrelation", MATH)
def attribute_correlation(table: DataFrame, fields: list[str]) -> DataFrame:
    """Pearson's r of every pair of numeric attributes."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i:]]
    one = table.agg(F.array(*[F.struct(F.lit(a).alias("field1"), F.lit(b).alias("field2"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs]).alias("rows"))
    return one.select(F.explode("rows").alias("x")).select("x.field1", "x.field2", "x.r")


@tool("AttributeHistogram", MATH)
def attribute_histogram(table: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """Counts of equal-width bins of an attribute."""
    own = table.select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col(field).cast("double").alias("value"))
    return raster_histogram(own, bins)


@tool("AttributeScattergram", MATH)
def attribute_scattergram(table: DataFrame, fieldx: str, fieldy: str) -> DataFrame:
    """The trend line of two attributes."""
    x, y = F.col(fieldx).cast("double"), F.col(fieldy).cast("double")
    return table.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"))


register("ImageStackProfile", IMAGE, lambda points, layers: points.join(_stack(layers), KEY, "left").select("id", "layer", "value"), "Values of a stack of rasters at points (id, row, col).")


def _stack(layers: list[DataFrame]) -> DataFrame:
    from .cellmath import stacked

    return stacked(layers)
