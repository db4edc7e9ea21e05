"""Geomorphometry: derivatives of a fitted surface, elevation residuals and neighbourhood measures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..plans.focal import EIGHT, shifted, tiled, window
from ..registry import register, tool
from .image import _extrema, _of, box_stats

TERRAIN = "Geomorphometric Analysis"
HYDRO = "Hydrological Analysis"
GIS = "GIS Analysis"
KEY = ["row", "col"]


def derivative_weights() -> dict[str, np.ndarray]:
    """5x5 weights of p, q, r, s, t: derivatives at the centre of the third-order polynomial fitted by least squares.

    x grows with the column, y against the row; both in cells.
    """
    y, x = np.meshgrid([2, 1, 0, -1, -2], [-2, -1, 0, 1, 2], indexing="ij")
    x, y = x.reshape(-1).astype(float), y.reshape(-1).astype(float)
    terms = np.stack([x**3, y**3, x * x * y, x * y * y, x * x, y * y, x * y, x, y, np.ones_like(x)], axis=1)
    fit = np.linalg.pinv(terms)
    return {"p": fit[7], "q": fit[8], "r": 2 * fit[4], "s": fit[6], "t": 2 * fit[5]}


_ORDER = {"p": 1, "q": 1, "r": 2, "s": 2, "t": 2}


def derivatives(dem: DataFrame, resolution: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    """row, col, p, q, r, s, t; missing neighbours are taken as the centre."""
    weights = {k: w / resolution ** _ORDER[k] * z_factor for k, w in derivative_weights().items()}

    def run(g):
        w = window(g, 2)
        w = np.where(np.isnan(w), g, w)
        return [np.where(np.isnan(g), np.nan, np.tensordot(k, w, 1)) for k in weights.values()]

    return tiled([dem], 2, run, names=tuple(weights))


_P2 = "(p * p + q * q)"
_MEAN = f"(-((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * sqrt(pow(1 + {_P2}, 3))))"
_GAUSS = f"((r * t - s * s) / pow(1 + {_P2}, 2))"
_ROOT = f"sqrt(greatest({_MEAN} * {_MEAN} - {_GAUSS}, 0))"
#: Curvatures over p, q, r, s, t; the same text serves other SQL engines.
CURVATURES = {
    "PlanCurvature": f"case when abs(p) + abs(q) > 0 then -(q * q * r - 2 * p * q * s + p * p * t) / sqrt(pow({_P2}, 3)) else 0 end",
    "ProfileCurvature": f"case when abs(p) + abs(q) > 0 then -(p * p * r + 2 * p * q * s + q * q * t) / ({_P2} * sqrt(pow(1 + {_P2}, 3))) else 0 end",
    "TangentialCurvature": f"case when abs(p) + abs(q) > 0 then -(q * q * r - 2 * p * q * s + p * p * t) / ({_P2} * sqrt(1 + {_P2})) else 0 end",
    "MeanCurvature": _MEAN,
    "GaussianCurvature": _GAUSS,
    "MaximalCurvature": f"{_MEAN} + {_ROOT}",
    "MinimalCurvature": f"{_MEAN} - {_ROOT}",
    "TotalCurvature": "r * r + 2 * s * s + t * t",
}
SLOPES = {"degrees": f"degrees(atan(sqrt{_P2}))", "radians": f"atan(sqrt{_P2})", "percent": f"sqrt{_P2} * 100"}
ASPECT = "case when p = 0 and q = 0 then -1 when p = 0 then case when q > 0 then 180 else 0 end else 180 - degrees(atan(q / p)) + 90 * sign(p) end"


def _expr(dem: DataFrame, text: str, resolution: float, z_factor: float) -> DataFrame:
    return derivatives(dem, resolution, z_factor).select(*KEY, F.when(F.col("p").isNotNull(), F.expr(text)).cast("double").alias("value"))


for _name, _text in CURVATURES.items():
    register(_name, TERRAIN, (lambda t: lambda dem, resolution=1.0, z_factor=1.0: _expr(dem, t, resolution, z_factor))(_text), f"{_name} of the fitted surface.")


@tool("Slope", TERRAIN)
def slope(dem: DataFrame, units: str = "degrees", resolution: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    """Slope in degrees, radians or percent."""
    return _expr(dem, SLOPES[units], resolution, z_factor)


@tool("Aspect", TERRAIN)
def aspect(dem: DataFrame, resolution: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    """Degrees clockwise from north that the surface faces; -1 if flat."""
    return _expr(dem, ASPECT, resolution, z_factor)


def hillshade_text(azimuth: float = 315.0, altitude: float = 30.0) -> str:
    """The illumination of p, q as SQL, 0 to 32767."""
    az, alt = math.radians(azimuth - 90), math.radians(altitude)
    t = f"greatest(sqrt{_P2}, 0.00017)"
    facing = f"(case when p = 0 then {math.pi!r} else {math.pi!r} - atan(q / p) + {math.pi / 2!r} * sign(p) end)"
    return f"round(greatest({t} / sqrt(1 + {t} * {t}) * ({math.sin(alt)!r} / {t} - {math.cos(alt)!r} * sin({az!r} - {facing})) * 32767, 0))"


@tool("Hillshade", TERRAIN)
def hillshade(dem: DataFrame, azimuth: float = 315.0, altitude: float = 30.0, resolution: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    """Shaded relief, 0 to 32767."""
    return _expr(dem, hillshade_text(azimuth, altitude), resolution, z_factor)


@tool("MultidirectionalHillshade", TERRAIN)
def multidirectional_hillshade(dem: DataFrame, altitude: float = 45.0, resolution: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    """Weighted shaded relief from azimuths 225, 270, 315 and 360."""
    weights = {225.0: 0.1, 270.0: 0.4, 315.0: 0.4, 360.0: 0.1}
    return _expr(dem, " + ".join(f"{w} * {hillshade_text(a, altitude)}" for a, w in weights.items()), resolution, z_factor)


@tool("StandardDeviationOfSlope", TERRAIN)
def standard_deviation_of_slope(dem: DataFrame, filterx: int = 11) -> DataFrame:
    """Standard deviation of slope in a window."""
    return _of(box_stats(slope(dem), filterx), F.col("stdev"))


@tool("CircularVarianceOfAspect", TERRAIN)
def circular_variance_of_aspect(dem: DataFrame, filterx: int = 11) -> DataFrame:
    """1 minus the length of the window's mean aspect vector."""
    a = aspect(dem)
    turn = F.radians("value")
    x = box_stats(a.withColumn("value", F.when(F.col("value") >= 0, F.sin(turn))), filterx).select(*KEY, F.col("mean").alias("x"))
    y = box_stats(a.withColumn("value", F.when(F.col("value") >= 0, F.cos(turn))), filterx).select(*KEY, F.col("mean").alias("y"))
    return a.join(x, KEY).join(y, KEY).select(*KEY, F.when(F.col("value").isNotNull(), 1 - F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("value"))


@tool("DiffFromMeanElev", TERRAIN)
def diff_from_mean_elev(dem: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """Elevation minus the window's mean."""
    return _of(box_stats(dem, filterx, filtery), F.col("value") - F.col("mean"))


@tool("DevFromMeanElev", TERRAIN)
def dev_from_mean_elev(dem: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """Elevation minus the window's mean, in its standard deviations; 0 if they are 0."""
    return _of(box_stats(dem, filterx, filtery), F.when(F.col("stdev") > 0, (F.col("value") - F.col("mean")) / F.col("stdev")).otherwise(0.0))


@tool("PercentElevRange", TERRAIN)
def percent_elev_range(dem: DataFrame, filterx: int = 3, filtery: int | None = None) -> DataFrame:
    """Percentage of the window's range at which an elevation lies; 0 if the range is 0."""
    return _of(_extrema(dem, filterx, filtery), F.when(F.col("hi") > F.col("lo"), 100 * (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(0.0))


@tool("RelativeTopographicPosition", TERRAIN)
def relative_topographic_position(dem: DataFrame, filterx: int = 11, filtery: int | None = None) -> DataFrame:
    """(z - mean) / (mean - min) below the mean, (z - mean) / (max - mean) above it."""
    both = box_stats(dem, filterx, filtery).join(_extrema(dem, filterx, filtery).select(*KEY, "lo", "hi"), KEY)
    d = F.col("value") - F.col("mean")
    below, above = F.nullif(F.col("mean") - F.col("lo"), F.lit(0.0)), F.nullif(F.col("hi") - F.col("mean"), F.lit(0.0))
    return _of(both, F.coalesce(F.when(d < 0, d / below).otherwise(d / above), F.lit(0.0)))


def _multiscale(dem: DataFrame, scales: list[int], measure) -> DataFrame:
    """Value and scale (half-width) of the greatest magnitude over window sizes."""
    out = None
    for k in scales:
        own = measure(dem, 2 * k + 1).select(*KEY, "value", F.lit(float(k)).alias("scale"))
        out = own if out is None else out.unionByName(own)
    best = F.struct((-F.abs("value")).alias("m"), "scale")
    return out.where("value is not null").groupBy(*KEY).agg(F.min_by("value", best).alias("value"), F.min_by("scale", best).alias("scale"))


@tool("MaxElevationDeviation", TERRAIN)
def max_elevation_deviation(dem: DataFrame, min_scale: int = 1, max_scale: int = 5, step: int = 1) -> DataFrame:
    """DevFromMeanElev of greatest magnitude over scales, and its scale."""
    return _multiscale(dem, list(range(min_scale, max_scale + 1, step)), dev_from_mean_elev)


@tool("MaxDifferenceFromMean", TERRAIN)
def max_difference_from_mean(dem: DataFrame, min_scale: int = 1, max_scale: int = 5, step: int = 1) -> DataFrame:
    """DiffFromMeanElev of greatest magnitude over scales, and its scale."""
    return _multiscale(dem, list(range(min_scale, max_scale + 1, step)), diff_from_mean_elev)


@tool("MaxElevDevSignature", TERRAIN)
def max_elev_dev_signature(dem: DataFrame, points: DataFrame, scales: list[int]) -> DataFrame:
    """DevFromMeanElev at points (id, row, col) for each scale."""
    out = None
    for k in scales:
        own = points.join(dev_from_mean_elev(dem, 2 * k + 1), KEY).select("id", F.lit(k).alias("scale"), "value")
        out = own if out is None else out.unionByName(own)
    return out


def _ring(dem: DataFrame, how) -> DataFrame:
    """A kernel of the centre and its eight neighbours."""
    return tiled([dem], 1, lambda g: np.where(np.isnan(g), np.nan, how(g, np.stack([shifted(g, r, c) for r, c in EIGHT]))))


def _or_nan(found: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(found, value, np.nan)


_RINGS = {
    "NumDownslopeNeighbours": (TERRAIN, lambda g, n: (n < g).sum(axis=0).astype(float)),
    "NumUpslopeNeighbours": (TERRAIN, lambda g, n: (n > g).sum(axis=0).astype(float)),
    "MaxDownslopeElevChange": (TERRAIN, lambda g, n: np.maximum(np.nanmax(np.where(np.isnan(n), -np.inf, g - n), axis=0), 0.0)),
    "MaxUpslopeElevChange": (TERRAIN, lambda g, n: np.maximum(np.nanmax(np.where(np.isnan(n), -np.inf, n - g), axis=0), 0.0)),
    "MinDownslopeElevChange": (TERRAIN, lambda g, n: (lambda d: _or_nan(np.isfinite(d), d))(np.min(np.where(n < g, g - n, np.inf), axis=0))),
    "RuggednessIndex": (TERRAIN, lambda g, n: np.sqrt(np.nansum((n - g) ** 2, axis=0) / np.maximum((~np.isnan(n)).sum(axis=0), 1))),
    "FindNoFlowCells": (HYDRO, lambda g, n: _or_nan(~(n < g).any(axis=0), np.ones_like(g))),
    "FillSingleCellPits": (HYDRO, lambda g, n: np.where((n > g).sum(axis=0) == 8, np.min(n, axis=0) + 0.0001, g)),
    "FD8Pointer": (HYDRO, lambda g, n: sum((n[i] < g) * 2.0**i for i in range(8))),
    "FindPatchOrClassEdgeCells": (GIS, lambda g, n: _or_nan(g > 0, np.where((n != g).any(axis=0), g, 0.0))),
}
for _name, (_box, _how) in _RINGS.items():
    register(_name, _box, (lambda h: lambda dem: _ring(dem, h))(_how), f"{_name} from the eight neighbours.")


def ring(name: str, dem: DataFrame) -> DataFrame:
    return _ring(dem, _RINGS[name][1])


@tool("EdgeProportion", GIS)
def edge_proportion(cells: DataFrame) -> DataFrame:
    """Share of each patch's cells that touch another class."""
    edge = ring("FindPatchOrClassEdgeCells", cells).where("value is not null").withColumnRenamed("value", "edge")
    own = cells.join(edge, KEY)
    return own.groupBy(F.round("value").alias("class")).agg(F.avg((F.col("edge") != 0).cast("double")).alias("edge_proportion"))


@tool("FindRidges", TERRAIN)
def find_ridges(dem: DataFrame) -> DataFrame:
    """1 where a cell is above both neighbours along its row or along its column, else 0."""
    return tiled([dem], 1, lambda g: np.where(np.isnan(g), np.nan, ((g > shifted(g, -1, 0)) & (g > shifted(g, 1, 0))) | ((g > shifted(g, 0, -1)) & (g > shifted(g, 0, 1)))))


@tool("ElevPercentile", TERRAIN)
def elev_percentile(dem: DataFrame, filterx: int = 11, sig_digits: int = 2) -> DataFrame:
    """Percentage of the window's cells in lower elevation bins."""
    from .image import percentile_filter

    return percentile_filter(dem, filterx, sig_digits)


def _normals(g: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = lambda r, c: np.where(np.isnan(shifted(g, r, c)), g, shifted(g, r, c))
    x = -(f(-1, 1) + 2 * f(0, 1) + f(1, 1) - f(-1, -1) - 2 * f(0, -1) - f(1, -1)) / (8 * resolution)
    y = -(f(-1, -1) + 2 * f(-1, 0) + f(-1, 1) - f(1, -1) - 2 * f(1, 0) - f(1, 1)) / (8 * resolution)
    n = np.sqrt(x * x + y * y + 1)
    return x / n, y / n, 1 / n


@tool("SphericalStdDevOfNormals", TERRAIN)
def spherical_std_dev_of_normals(dem: DataFrame, filterx: int = 11, resolution: float = 1.0) -> DataFrame:
    """Spherical standard deviation, in degrees, of the window's surface normals."""
    half = max(1, filterx // 2)

    def run(g):
        parts = [np.nansum(window(np.where(np.isnan(g), np.nan, v), half), axis=0) for v in _normals(g, resolution)]
        n = (~np.isnan(window(g, half))).sum(axis=0)
        mean = np.clip(np.sqrt(sum(p * p for p in parts)) / np.maximum(n, 1), 1e-12, 1.0)
        return np.where(np.isnan(g), np.nan, np.degrees(np.sqrt(-2 * np.log(mean))))

    return tiled([dem], half + 1, run)


@tool("AverageNormalVectorAngularDeviation", TERRAIN)
def average_normal_vector_angular_deviation(dem: DataFrame, filterx: int = 11, resolution: float = 1.0) -> DataFrame:
    """Angle, in degrees, between a cell's normal and the window's mean normal."""
    half = max(1, filterx // 2)

    def run(g):
        own = [np.where(np.isnan(g), np.nan, v) for v in _normals(g, resolution)]
        mean = [np.nansum(window(v, half), axis=0) for v in own]
        size = np.sqrt(sum(m * m for m in mean))
        return np.degrees(np.arccos(np.clip(sum(a * m for a, m in zip(own, mean, strict=True)) / size, -1, 1)))

    return tiled([dem], half + 1, run)


@tool("SurfaceAreaRatio", TERRAIN)
def surface_area_ratio(dem: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Area of the eight triangles to the neighbours, halved, over the cell's planar area."""

    def run(g):
        ring_ = [np.where(np.isnan(shifted(g, r, c)), g, shifted(g, r, c)) for r, c in EIGHT]
        area = np.zeros_like(g)
        for i in range(8):
            a, b = EIGHT[i], EIGHT[(i + 1) % 8]
            u = (a[1] * resolution / 2, -a[0] * resolution / 2, (ring_[i] - g) / 2)
            v = (b[1] * resolution / 2, -b[0] * resolution / 2, (ring_[(i + 1) % 8] - g) / 2)
            cx, cy, cz = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
            area += np.sqrt(cx * cx + cy * cy + cz * cz) / 2
        return area / resolution**2

    return tiled([dem], 1, run)


def _towards(g: np.ndarray, azimuth: float, steps: int):
    """The value at each distance along an azimuth, by the nearest cell."""
    a = math.radians(azimuth)
    for d in range(1, steps + 1):
        yield d, shifted(g, round(-math.cos(a) * d), round(math.sin(a) * d))


@tool("DirectionalRelief", TERRAIN)
def directional_relief(dem: DataFrame, azimuth: float = 0.0, max_dist: int = 20) -> DataFrame:
    """Mean elevation along a ray minus the cell's own."""

    def run(g):
        ray = np.stack([v for _, v in _towards(g, azimuth, max_dist)])
        return np.nanmean(ray, axis=0) - g

    return tiled([dem], max_dist, run)


@tool("HorizonAngle", TERRAIN)
def horizon_angle(dem: DataFrame, azimuth: float = 0.0, max_dist: int = 20, resolution: float = 1.0) -> DataFrame:
    """Greatest angle, in degrees, up to what lies along an azimuth."""

    def run(g):
        return np.degrees(np.arctan(np.nanmax(np.stack([np.where(np.isnan(v), -np.inf, (v - g) / (d * resolution)) for d, v in _towards(g, azimuth, max_dist)]), axis=0)))

    return tiled([dem], max_dist, run)


@tool("FetchAnalysis", TERRAIN)
def fetch_analysis(dem: DataFrame, azimuth: float = 0.0, hgt_inc: float = 0.05, max_dist: int = 50, resolution: float = 1.0) -> DataFrame:
    """Distance upwind to the first obstacle; negative, to the edge or the limit, if there is none."""

    def run(g):
        out, far = np.full_like(g, np.nan), np.zeros_like(g)
        for d, v in _towards(g, azimuth, max_dist):
            far = np.where(np.isnan(v), far, d * resolution)
            hit = np.isnan(out) & (v >= g + d * resolution * hgt_inc)
            out = np.where(hit, d * resolution, out)
        return np.where(np.isnan(g), np.nan, np.where(np.isnan(out), -far, out))

    return tiled([dem], max_dist, run)


@tool("Geomorphons", TERRAIN)
def geomorphons(dem: DataFrame, search: int = 10, threshold: float = 1.0, resolution: float = 1.0) -> DataFrame:
    """Landform class 1 to 10 by how many of eight directions rise and fall along lines of sight."""
    table = np.array([[1, 1, 1, 8, 8, 9, 9, 9, 10], [1, 1, 8, 8, 8, 9, 9, 9, 0], [1, 4, 6, 6, 7, 7, 9, 0, 0], [4, 4, 6, 6, 6, 7, 0, 0, 0], [4, 4, 5, 6, 6, 0, 0, 0, 0], [3, 3, 5, 5, 0, 0, 0, 0, 0], [3, 3, 3, 0, 0, 0, 0, 0, 0], [3, 3, 0, 0, 0, 0, 0, 0, 0], [2, 0, 0, 0, 0, 0, 0, 0, 0]])
    flat = math.tan(math.radians(threshold))

    def run(g):
        rise, fall = np.zeros(g.shape, int), np.zeros(g.shape, int)
        for i in range(8):
            slopes = [np.where(np.isnan(v), np.nan, (v - g) / (d * resolution * (math.sqrt(2) if i % 2 else 1.0))) for d, v in ((d, shifted(g, *(x * d for x in [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)][i]))) for d in range(1, search + 1))]
            s = np.stack(slopes)
            up, down = np.nanmax(np.where(np.isnan(s), -np.inf, s), axis=0), np.nanmin(np.where(np.isnan(s), np.inf, s), axis=0)
            up, down = np.where(np.isfinite(up), up, 0.0), np.where(np.isfinite(down), down, 0.0)
            rise += (up > flat) & (up >= -down)
            fall += (down < -flat) & (-down > up)
        return np.where(np.isnan(g), np.nan, table[fall, rise])

    return tiled([dem], search, run)


@tool("PennockLandformClass", TERRAIN)
def pennock_landform_class(dem: DataFrame, slope_threshold: float = 3.0, prof: float = 0.1, plan: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Seven landform elements by slope, profile and plan curvature; NoData where none fits."""
    d = derivatives(dem, resolution)
    d = d.select(*KEY, F.expr(SLOPES["degrees"]).alias("slope"), F.degrees(F.expr(CURVATURES["ProfileCurvature"])).alias("prof"), F.degrees(F.expr(CURVATURES["PlanCurvature"])).alias("plan"))
    s, pr, pl = F.col("slope") > slope_threshold, F.col("prof"), F.col("plan")
    value = F.when(s & (pr < -prof) & (pl <= -plan), 1).when(s & (pr < -prof) & (pl > plan), 2).when(s & (pr > prof) & (pl <= -plan), 3).when(s & (pr > prof) & (pl > plan), 4).when(s & (F.abs("prof") <= prof) & (pl <= -plan), 5).when(s & (F.abs("prof") <= prof) & (pl > plan), 6).when(~s, 7)
    return d.select(*KEY, value.cast("double").alias("value"))


register("Profile", TERRAIN, lambda dem, line: line.join(dem, KEY, "left").select("line", "distance", "value"), "Values along lines sampled as (line, distance, row, col).")
