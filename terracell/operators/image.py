"""Image filters.

Sums and extrema over rectangles are separable range-frame windows in the JVM; filters of order
statistics, of weights and of value differences run as NumPy kernels over tiles with halos.  Output is NoData
where the centre is.  Box sums follow the reference's integral images, which never count row 0 and
column 0; ``strict=False`` counts them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..plans.focal import boxes, shifted, tiled, window
from ..registry import register, tool

IMAGE = "Image Processing"
KEY = ["row", "col"]


def odd(size: int) -> int:
    """Filter sizes are odd and at least 3."""
    size = max(3, size)
    return size + 1 - size % 2


def _half(filterx: int, filtery: int | None) -> tuple[int, int]:
    return odd(filtery or filterx) // 2, odd(filterx) // 2


def box_stats(cells: DataFrame, filterx: int = 11, filtery: int | None = None, strict: bool = True) -> DataFrame:
    """row, col, value and the window's n, mean, total and stdev (population)."""
    v = F.col("value")
    own = F.when((F.col("row") > 0) & (F.col("col") > 0), v) if strict else v
    out = boxes(cells, _half(filterx, filtery), {"n": (F.sum, F.when(own.isNotNull(), 1).otherwise(0)), "s": (F.sum, own), "q": (F.sum, own * own)})
    n = F.nullif(F.col("n"), F.lit(0))
    mean = F.coalesce(F.col("s") / n, F.lit(0.0))
    return out.select(*KEY, "value", "n", mean.alias("mean"), F.coalesce("s", F.lit(0.0)).alias("total"), F.coalesce(F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))), F.lit(0.0)).alias("stdev"))


def _of(stats: DataFrame, how) -> DataFrame:
    return stats.select(*KEY, F.when(F.col("value").isNotNull(), how).alias("value"))


@tool("MeanFilter", IMAGE)
def mean_filter(cells: DataFrame, filterx: int = 3, filtery: int | None = None, strict: bool = True) -> DataFrame:
    """Mean of a window."""
    return _of(box_stats(cells, filterx, filtery, strict), F.col("mean"))


@tool("TotalFilter", IMAGE)
def total_filter(cells: DataFrame, filterx: int = 11, filtery: int | None = None, strict: bool = True) -> DataFrame:
    """Sum of a window."""
    return _of(box_stats(cells, filterx, filtery, strict), F.col("total"))


@tool("StandardDeviationFilter", IMAGE)
def standard_deviation_filter(cells: DataFrame, filterx: int = 11, filtery: int | None = None, strict: bool = True) -> DataFrame:
    """Standard deviation of a window."""
    return _of(box_stats(cells, filterx, filtery, strict), F.col("stdev"))


@tool("HighPassFilter", IMAGE)
def high_pass_filter(cells: DataFrame, filterx: int = 11, filtery: int | None = None, strict: bool = True) -> DataFrame:
    """Value minus the window's mean."""
    return _of(box_stats(cells, filterx, filtery, strict), F.col("value") - F.col("mean"))


@tool("AdaptiveFilter", IMAGE)
def adaptive_filter(cells: DataFrame, filterx: int = 11, filtery: int | None = None, threshold: float = 2.0, strict: bool = True) -> DataFrame:
    """The mean where a value is over some deviations away from it, else the value."""
    far = F.abs(F.col("value") - F.col("mean")) > threshold * F.col("stdev")
    return _of(box_stats(cells, filterx, filtery, strict), F.when(far & (F.col("stdev") > 0), F.col("mean")).otherwise(F.col("value")))


def _extrema(cells: DataFrame, filterx: int, filtery: int | None) -> DataFrame:
    v = F.col("value")
    return boxes(cells, _half(filterx, filtery), {"lo": (F.min, v), "hi": (F.max, v)})


@tool("MaximumFilter", IMAGE)
def maximum_filter(cells: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """Maximum of a window."""
    return _of(_extrema(cells, filterx, filtery), F.col("hi"))


@tool("MinimumFilter", IMAGE)
def minimum_filter(cells: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """Minimum of a window."""
    return _of(_extrema(cells, filterx, filtery), F.col("lo"))


@tool("RangeFilter", IMAGE)
def range_filter(cells: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """Maximum minus minimum of a window."""
    return _of(_extrema(cells, filterx, filtery), F.col("hi") - F.col("lo"))


@tool("Opening", IMAGE)
def opening(cells: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """Minimum, then maximum of a window."""
    return maximum_filter(minimum_filter(cells, filterx, filtery), filterx, filtery)


@tool("Closing", IMAGE)
def closing(cells: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """Maximum, then minimum of a window."""
    return minimum_filter(maximum_filter(cells, filterx, filtery), filterx, filtery)


@tool("TophatTransform", IMAGE)
def tophat_transform(cells: DataFrame, filterx: int = 11, filtery: int | None = None, variant: str = "white") -> DataFrame:
    """Value minus its opening (white), or its closing minus the value (black)."""
    other = (opening if variant == "white" else closing)(cells, filterx, filtery).withColumnRenamed("value", "other")
    v = F.col("value") - F.col("other") if variant == "white" else F.col("other") - F.col("value")
    return cells.join(other, KEY).select(*KEY, v.alias("value"))


@tool("IntegralImage", IMAGE)
def integral_image(cells: DataFrame) -> DataFrame:
    """Sum of all cells above and to the left, the cell included."""
    from pyspark.sql import Window as W

    to_here = lambda part, order: W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = cells.select(*KEY, F.sum(F.coalesce("value", F.lit(0.0))).over(to_here("row", "col")).alias("s"))
    return rows.select(*KEY, F.sum("s").over(to_here("col", "row")).alias("value"))


# -- kernels ----------------------------------------------------------------------------------------------------


def _focal(cells: DataFrame, half: int, kernel) -> DataFrame:
    """A kernel of the centre and the stacked window, NoData where the centre is."""
    return tiled([cells], half, lambda g: np.where(np.isnan(g), np.nan, kernel(g, window(g, half))))


def _filled(w: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(w), centre, w)


def convolved(cells: DataFrame, *kernels: np.ndarray, combine=None, absvals: bool = False) -> DataFrame:
    """Sums of weights times values, missing neighbours taken as the centre."""
    half = max(k.shape[0] // 2 for k in kernels)

    def run(g, w):
        w = _filled(w, g)
        sums = [np.tensordot(k.reshape(-1), w, 1) for k in kernels]
        out = combine(*sums) if combine else sums[0]
        return np.abs(out) if absvals else out

    return _focal(cells, half, run)


_SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
_SOBEL5 = np.array([[2, 1, 0, -1, -2], [3, 2, 0, -2, -3], [4, 3, 0, -3, -4], [3, 2, 0, -2, -3], [2, 1, 0, -1, -2]], float)
_PREWITT = np.array([[-1, 0, 1]] * 3, float)
_SCHARR = np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)
_LAPLACE = {
    "3x3(1)": [[0, -1, 0], [-1, 4, -1], [0, -1, 0]],
    "3x3(2)": [[0, -1, 0], [-1, 5, -1], [0, -1, 0]],
    "3x3(3)": [[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]],
    "3x3(4)": [[1, -2, 1], [-2, 4, -2], [1, -2, 1]],
    "5x5(1)": [[0, 0, -1, 0, 0], [0, -1, -2, -1, 0], [-1, -2, 17, -2, -1], [0, -1, -2, -1, 0], [0, 0, -1, 0, 0]],
    "5x5(2)": [[0, 0, -1, 0, 0], [0, -1, -2, -1, 0], [-1, -2, 16, -2, -1], [0, -1, -2, -1, 0], [0, 0, -1, 0, 0]],
}
_LINES = {"v": [[-1, 2, -1]] * 3, "h": [[-1, -1, -1], [2, 2, 2], [-1, -1, -1]], "45": [[-1, -1, 2], [-1, 2, -1], [2, -1, -1]], "135": [[2, -1, -1], [-1, 2, -1], [-1, -1, 2]]}
_TOWARDS = {"n": (-1, 0), "s": (1, 0), "e": (0, 1), "w": (0, -1), "ne": (-1, 1), "nw": (-1, -1), "se": (1, 1), "sw": (1, -1)}
_magnitude = lambda x, y: np.sqrt(x * x + y * y)


@tool("SobelFilter", IMAGE)
def sobel_filter(cells: DataFrame, variant: str = "3x3") -> DataFrame:
    """Gradient magnitude by Sobel's kernels."""
    k = _SOBEL if variant == "3x3" else _SOBEL5
    return convolved(cells, k, k.T, combine=_magnitude)


@tool("PrewittFilter", IMAGE)
def prewitt_filter(cells: DataFrame) -> DataFrame:
    """Gradient magnitude by Prewitt's kernels."""
    return convolved(cells, _PREWITT, _PREWITT.T, combine=_magnitude)


@tool("ScharrFilter", IMAGE)
def scharr_filter(cells: DataFrame) -> DataFrame:
    """Gradient magnitude by Scharr's kernels."""
    return convolved(cells, _SCHARR, _SCHARR.T, combine=_magnitude)


@tool("RobertsCrossFilter", IMAGE)
def roberts_cross_filter(cells: DataFrame) -> DataFrame:
    """Sum of the absolute differences of the two diagonals of a 2x2 block."""
    a, b = np.zeros((3, 3)), np.zeros((3, 3))
    a[1, 1], a[2, 2], b[1, 2], b[2, 1] = 1, -1, 1, -1
    return convolved(cells, a, b, combine=lambda x, y: np.abs(x) + np.abs(y))


@tool("LaplacianFilter", IMAGE)
def laplacian_filter(cells: DataFrame, variant: str = "3x3(1)") -> DataFrame:
    """One of six Laplacian kernels."""
    return convolved(cells, np.array(_LAPLACE[variant], float))


@tool("EmbossFilter", IMAGE)
def emboss_filter(cells: DataFrame, direction: str = "n") -> DataFrame:
    """Difference of the two neighbours along a direction."""
    k = np.zeros((3, 3))
    dr, dc = _TOWARDS[direction.lower()]
    k[1 + dr, 1 + dc], k[1 - dr, 1 - dc] = -1, 1
    return convolved(cells, -k if direction.lower() in ("e", "w") else k)


@tool("LineDetectionFilter", IMAGE)
def line_detection_filter(cells: DataFrame, variant: str = "v", absvals: bool = False) -> DataFrame:
    """A kernel for vertical, horizontal, 45 or 135 degree lines."""
    return convolved(cells, np.array(_LINES[variant], float), absvals=absvals)


@tool("UserDefinedWeightsFilter", IMAGE)
def user_defined_weights_filter(cells: DataFrame, weights: list[list[float]], normalize: bool = False) -> DataFrame:
    """A kernel of given weights; missing neighbours are left out."""
    k = np.array(weights, float)
    half = k.shape[0] // 2

    def run(g, w):
        known = ~np.isnan(w)
        total = np.tensordot(k.reshape(-1), np.where(known, w, 0.0), 1)
        return total / np.tensordot(k.reshape(-1), known.astype(float), 1) if normalize else total

    return _focal(cells, half, run)


def _gauss(sigma: float) -> np.ndarray:
    half = max(1, int(np.ceil(2.6 * sigma)))
    d = np.arange(-half, half + 1)
    return np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * sigma * sigma))


def _smoothed(w: np.ndarray, weights: np.ndarray) -> np.ndarray:
    known = ~np.isnan(w)
    shape = (-1,) + (1,) * (w.ndim - 1)
    k = weights if weights.ndim == w.ndim else weights.reshape(shape)
    return (np.where(known, w, 0.0) * k).sum(axis=0) / (known * k).sum(axis=0)


@tool("GaussianFilter", IMAGE)
def gaussian_filter(cells: DataFrame, sigma: float = 0.75) -> DataFrame:
    """Gaussian-weighted mean of the cells with data."""
    k = _gauss(sigma)
    return _focal(cells, k.shape[0] // 2, lambda g, w: _smoothed(w, k.reshape(-1)))


@tool("DiffOfGaussianFilter", IMAGE)
def diff_of_gaussian_filter(cells: DataFrame, sigma1: float = 2.0, sigma2: float = 4.0) -> DataFrame:
    """Difference of two Gaussian means."""
    a, b = gaussian_filter(cells, sigma1), gaussian_filter(cells, sigma2).withColumnRenamed("value", "other")
    return a.join(b, KEY).select(*KEY, (F.col("value") - F.col("other")).alias("value"))


@tool("LaplacianOfGaussianFilter", IMAGE)
def laplacian_of_gaussian_filter(cells: DataFrame, sigma: float = 0.75) -> DataFrame:
    """Laplacian-of-Gaussian kernel."""
    half = max(1, int(np.ceil(3 * sigma)))
    d = np.arange(-half, half + 1)
    r = (d[:, None] ** 2 + d[None, :] ** 2) / (2 * sigma * sigma)
    return convolved(cells, -1 / (np.pi * sigma**4) * (1 - r) * np.exp(-r))


@tool("UnsharpMasking", IMAGE)
def unsharp_masking(cells: DataFrame, sigma: float = 0.75, amount: float = 100.0, threshold: float = 0.0) -> DataFrame:
    """Adds a share of the difference from the Gaussian mean where it is over the threshold."""
    soft = gaussian_filter(cells, sigma).withColumnRenamed("value", "soft")
    d = F.col("value") - F.col("soft")
    return cells.join(soft, KEY).select(*KEY, F.when(F.abs(d) > threshold, F.col("value") + d * amount / 100).otherwise(F.col("value")).alias("value"))


@tool("FastAlmostGaussianFilter", IMAGE)
def fast_almost_gaussian_filter(cells: DataFrame, sigma: float = 1.8) -> DataFrame:
    """Five box means whose widths approach a Gaussian."""
    n = 5
    low = int(np.floor(np.sqrt(12 * sigma**2 / n + 1)))
    low -= 1 - low % 2
    low = max(low, 1)
    m = round((12 * sigma**2 - n * low**2 - 4 * n * low - 3 * n) / (-4 * low - 4))
    out = cells
    for i in range(n):
        size = low if i < m else low + 2
        if size >= 3:
            out = mean_filter(out, size, size, strict=False)
    return out


@tool("BilateralFilter", IMAGE)
def bilateral_filter(cells: DataFrame, sigma_dist: float = 0.75, sigma_int: float = 1.0) -> DataFrame:
    """Mean weighted by distance and by difference in value."""
    k = _gauss(sigma_dist).reshape(-1, 1, 1)
    return _focal(cells, int(np.sqrt(k.size)) // 2, lambda g, w: _smoothed(w, k * np.nan_to_num(np.exp(-((w - g) ** 2) / (2 * sigma_int**2)))))


@tool("HighPassBilateralFilter", IMAGE)
def high_pass_bilateral_filter(cells: DataFrame, sigma_dist: float = 0.75, sigma_int: float = 1.0) -> DataFrame:
    """Value minus the bilateral mean."""
    soft = bilateral_filter(cells, sigma_dist, sigma_int).withColumnRenamed("value", "soft")
    return cells.join(soft, KEY).select(*KEY, (F.col("value") - F.col("soft")).alias("value"))


def _bins(w: np.ndarray, sig_digits: int) -> np.ndarray:
    return np.floor(w * 10.0**sig_digits)


@tool("MedianFilter", IMAGE)
def median_filter(cells: DataFrame, filterx: int = 11, sig_digits: int = 2) -> DataFrame:
    """Lower median of values floored to some decimals."""

    def run(g, w):
        s = np.sort(_bins(w, sig_digits), axis=0)  # NaN last
        n = (~np.isnan(w)).sum(axis=0)
        at = np.maximum(np.ceil(np.floor(n / 2)).astype(int) - 1, 0)
        return np.take_along_axis(s, at[None], 0)[0] / 10.0**sig_digits

    return _focal(cells, odd(filterx) // 2, run)


@tool("HighPassMedianFilter", IMAGE)
def high_pass_median_filter(cells: DataFrame, filterx: int = 11, sig_digits: int = 2) -> DataFrame:
    """Value minus the window's median."""
    soft = median_filter(cells, filterx, sig_digits).withColumnRenamed("value", "soft")
    return cells.join(soft, KEY).select(*KEY, (F.col("value") - F.col("soft")).alias("value"))


@tool("PercentileFilter", IMAGE)
def percentile_filter(cells: DataFrame, filterx: int = 11, sig_digits: int = 2) -> DataFrame:
    """Percentage of the window's cells in lower bins than the centre's."""
    return _focal(cells, odd(filterx) // 2, lambda g, w: 100.0 * (_bins(w, sig_digits) < _bins(g, sig_digits)).sum(axis=0) / (~np.isnan(w)).sum(axis=0))


@tool("MajorityFilter", IMAGE)
def majority_filter(cells: DataFrame, filterx: int = 11) -> DataFrame:
    """Commonest rounded value of the window, the smallest on ties."""

    def run(g, w):
        s = np.sort(np.round(w), axis=0)
        best, n, run_n = s[0].copy(), np.ones(g.shape, int), np.ones(g.shape, int)
        for i in range(1, len(s)):
            run_n = np.where(s[i] == s[i - 1], run_n + 1, 1)
            better = (run_n > n) & ~np.isnan(s[i])
            best, n = np.where(better, s[i], best), np.where(better, run_n, n)
        return best

    return _focal(cells, odd(filterx) // 2, run)


@tool("DiversityFilter", IMAGE)
def diversity_filter(cells: DataFrame, filterx: int = 11) -> DataFrame:
    """Number of distinct rounded values of the window."""

    def run(g, w):
        s = np.sort(np.round(w), axis=0)
        return 1.0 + ((s[1:] != s[:-1]) & ~np.isnan(s[1:])).sum(axis=0)

    return _focal(cells, odd(filterx) // 2, run)


@tool("OlympicFilter", IMAGE)
def olympic_filter(cells: DataFrame, filterx: int = 11) -> DataFrame:
    """Mean of the window without its least and greatest values."""

    def run(g, w):
        n = (~np.isnan(w)).sum(axis=0)
        out = (np.nansum(w, axis=0) - np.nanmin(w, axis=0) - np.nanmax(w, axis=0)) / np.maximum(n - 2, 1)
        return np.where(n > 2, out, g)

    return _focal(cells, odd(filterx) // 2, run)


@tool("ConservativeSmoothingFilter", IMAGE)
def conservative_smoothing_filter(cells: DataFrame, filterx: int = 3) -> DataFrame:
    """Values brought into the range of their neighbours."""

    def run(g, w):
        others = np.delete(w, len(w) // 2, axis=0)
        return np.where(np.isnan(others).all(axis=0), g, np.clip(g, np.nanmin(others, axis=0), np.nanmax(others, axis=0)))

    return _focal(cells, odd(filterx) // 2, run)


@tool("EdgePreservingMeanFilter", IMAGE)
def edge_preserving_mean_filter(cells: DataFrame, filterx: int = 11, threshold: float = 15.0) -> DataFrame:
    """Mean of the window's values that differ from the centre by less than a threshold."""
    return _focal(cells, odd(filterx) // 2, lambda g, w: np.nanmean(np.where(np.abs(w - g) < threshold, w, np.nan), axis=0))


@tool("KNearestMeanFilter", IMAGE)
def k_nearest_mean_filter(cells: DataFrame, filterx: int = 11, k: int = 5) -> DataFrame:
    """Mean of the k values of the window nearest to the centre's."""

    def run(g, w):
        order = np.argsort(np.abs(w - g), axis=0, kind="stable")[:k]
        return np.nanmean(np.take_along_axis(w, order, 0), axis=0)

    return _focal(cells, odd(filterx) // 2, run)


@tool("LeeSigmaFilter", IMAGE)
def lee_sigma_filter(cells: DataFrame, filterx: int = 11, sigma: float = 10.0, m: float = 5.0) -> DataFrame:
    """Mean of values within sigma of the centre if more than m, else of the eight neighbours."""
    half = odd(filterx) // 2

    def run(g, w):
        near = np.abs(w - g) <= sigma
        n = near.sum(axis=0)
        ring = np.stack([shifted(g, r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])
        k = (~np.isnan(ring)).sum(axis=0)
        return np.where(n > m, np.where(near, w, 0.0).sum(axis=0) / np.maximum(n, 1), np.where(k > 0, np.nansum(ring, axis=0) / np.maximum(k, 1), g))

    return _focal(cells, half, run)


def _hit_or_miss(patterns: list[list[list[int]]], on: np.ndarray) -> np.ndarray:
    """Where any 3x3 pattern of 1, 0 and -1 (any) fits."""
    out = np.zeros(on.shape, bool)
    for p in patterns:
        fit = np.ones(on.shape, bool)
        for r in range(3):
            for c in range(3):
                if p[r][c] >= 0:
                    there = np.nan_to_num(shifted(on.astype(float), r - 1, c - 1)) > 0
                    fit &= there == bool(p[r][c])
        out |= fit
    return out


def _turned(p: list[list[int]]) -> list[list[list[int]]]:
    a = np.array(p)
    return [np.rot90(a, i).tolist() for i in range(4)]


@tool("CornerDetection", IMAGE)
def corner_detection(cells: DataFrame) -> DataFrame:
    """1 where one of four right-angled corner patterns fits, else 0."""
    patterns = _turned([[-1, 1, -1], [0, 1, 1], [0, 0, -1]])
    return tiled([cells], 1, lambda g: np.where(np.isnan(g), np.nan, _hit_or_miss(patterns, np.nan_to_num(g) > 0)))


@tool("ThickenRasterLine", IMAGE)
def thicken_raster_line(cells: DataFrame) -> DataFrame:
    """Fills a cell between two diagonal line cells, so that lines block four-way neighbours."""

    def run(g):
        on = np.nan_to_num(g) > 0
        s = lambda r, c: np.nan_to_num(shifted(on.astype(float), r, c)) > 0
        gap = ~on & ((s(-1, 0) & s(0, 1) & ~s(-1, 1)) | (s(-1, 0) & s(0, -1) & ~s(-1, -1)))
        return np.where(np.isnan(g), np.nan, np.where(gap, np.fmax(shifted(g, -1, 0), 0), g))

    return tiled([cells], 1, run)


def _until_stable(cells: DataFrame, kernel, halo: int, rounds: int | None = None) -> DataFrame:
    """A tile kernel repeated over checkpoints until no cell changes."""
    from ..plans.iterate import cut

    now, done = cut(cells), 0
    while rounds is None or done < rounds:
        new = cut(tiled([now], halo, kernel))
        done += 1
        changed = new.join(now.withColumnRenamed("value", "old"), KEY).where(~F.col("value").eqNullSafe(F.col("old"))).limit(1)
        now = new
        if changed.isEmpty():
            break
    return now


_THIN = [p for pair in zip(_turned([[0, 0, 0], [-1, 1, -1], [1, 1, 1]]), _turned([[-1, 0, 0], [1, 1, 0], [-1, 1, -1]]), strict=True) for p in pair]


@tool("LineThinning", IMAGE)
def line_thinning(cells: DataFrame) -> DataFrame:
    """Lines thinned to one cell by eight hit-or-miss patterns until nothing changes."""

    def run(g):
        on = np.nan_to_num(g) > 0
        for p in _THIN:
            on &= ~_hit_or_miss([p], on)
        return np.where(np.isnan(g), np.nan, np.where(on, g, 0.0))

    return _until_stable(cells, run, 8)


@tool("RemoveSpurs", IMAGE)
def remove_spurs(cells: DataFrame, iterations: int = 10) -> DataFrame:
    """End cells of lines taken off some times."""
    patterns = _turned([[0, 0, 0], [0, 1, 0], [0, -1, -1]]) + _turned([[0, 0, 0], [0, 1, 0], [-1, -1, 0]])

    def run(g):
        on = np.nan_to_num(g) > 0
        return np.where(np.isnan(g), np.nan, np.where(on & ~_hit_or_miss(patterns, on), g, 0.0))

    return _until_stable(cells, run, 1, iterations)


register("CorrectVignetting", IMAGE, lambda cells, row, col, focal, image_width, exponent=4.0: cells.withColumn("value", F.col("value") / F.pow(F.cos(F.atan(F.sqrt(F.pow(F.col("row") - row, 2.0) + F.pow(F.col("col") - col, 2.0)) / (focal * image_width))), F.lit(exponent))), "Brightens cells by their angle from a principal point.")
