"""Vector features: fid, shape_type, parts (array of first point numbers), points (array of x, y), attributes.

Measures of rings are higher-order functions and stay in JVM code.  Hulls, minimum boxes and circles are
NumPy kernels over Arrow batches, of all features of as many vertices at once; a hull of a whole layer is taken of each
partition first, so one task only gets hull corners.  Points meet polygons by an equi-join on the grid
buckets that a polygon's envelope covers, and the exact test follows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..registry import register, tool
from ..session import ship

DATA = "Data Tools"
GIS = "GIS Analysis"
SHAPE = "GIS Analysis/Patch Shape Tools"
#: Shapefile base types.
POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
POINTS = "array<struct<x:double,y:double>>"
FEATURE = ["fid", "shape_type", "parts", "points"]


# -- rings ------------------------------------------------------------------------------------------------------


def rings(points: str = "points", parts: str = "parts") -> Column:
    """The parts of a feature as an array of point arrays."""
    p = F.col(parts)
    return F.transform(p, lambda at, i: F.slice(F.col(points), at + 1, F.coalesce(F.get(p, i + 1), F.size(points)) - at))


def _edges(ring: Column, how: Callable[[Column, Column], Column]) -> Column:
    """``how`` of every edge's two ends, summed."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), how), F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    """Positive if the ring runs counter-clockwise."""
    return _edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def length(ring: Column) -> Column:
    return _edges(ring, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _areas(hull: bool) -> Column:
    """Area of the hulls or of the holes; a hole is a later ring that runs counter-clockwise."""
    found = F.transform(rings(), lambda r, i: F.struct((signed_area(r)).alias("a"), ((i > 0) & (signed_area(r) > 0)).alias("hole")))
    return _total(F.transform(found, lambda x: F.when(x["hole"] != hull, F.abs(x["a"])).otherwise(0.0)))


def perimeter() -> Column:
    return _total(F.transform(rings(), length))


def area() -> Column:
    return _areas(True) - _areas(False)


_MEASURES: dict[str, tuple[str, Callable[[], Column], str]] = {
    "PolygonArea": ("AREA", area, "Area of each polygon, holes taken off."),
    "PolygonPerimeter": ("PERIMETER", perimeter, "Length of all rings of each polygon."),
    "PerimeterAreaRatio": ("P_A_RATIO", lambda: perimeter() / area(), "Perimeter by area."),
    "CompactnessRatio": ("COMPACT", lambda: area() / perimeter(), "Area by perimeter."),
    "HoleProportion": ("HOLE_PROP", lambda: _areas(False) / _areas(True), "Area of the holes by that of the hulls."),
}
for _name, (_column, _how, _text) in _MEASURES.items():
    register(_name, SHAPE, (lambda c, h: lambda features: features.withColumn(c, h()))(_column, _how), _text)


def _moments() -> dict[str, Column]:
    """Number and sums of the first part's vertices, counted from the first one so that no digits are lost."""
    first = F.get(F.get(rings(), F.lit(0)), F.lit(0))
    ring = F.transform(F.get(rings(), F.lit(0)), lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    n = F.size(ring).cast("double")
    sums = F.aggregate(
        ring,
        F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")]),
        lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"), (s["xy"] + p["x"] * p["y"]).alias("xy")),
    )
    return {"n": n, "sums": sums}


def _with_moments(features: DataFrame) -> DataFrame:
    m = _moments()
    s = F.col("_sums")
    out = features.withColumns({"_sums": m["sums"], "_n": m["n"]})
    return out.withColumns({"_xx": s["xx"] / F.col("_n") - (s["x"] / F.col("_n")) ** 2, "_yy": s["yy"] / F.col("_n") - (s["y"] / F.col("_n")) ** 2, "_xy": s["xy"] / F.col("_n") - s["x"] * s["y"] / (F.col("_n") ** 2)})


@tool("LinearityIndex", SHAPE)
def linearity_index(features: DataFrame) -> DataFrame:
    """r squared of a line through the vertices of the first part; 0 where there is no spread."""
    r2 = F.coalesce(F.col("_xy") ** 2 / F.nullif(F.col("_xx") * F.col("_yy"), F.lit(0.0)), F.lit(0.0))
    return _with_moments(features).select(*features.columns, r2.alias("LINEARITY"))


@tool("PatchOrientation", SHAPE)
def patch_orientation(features: DataFrame) -> DataFrame:
    """Degrees from north of the reduced major axis of the first part's vertices."""
    slope = F.sqrt(F.col("_yy") / F.nullif(F.col("_xx"), F.lit(0.0)))
    slope = F.when(F.col("_xy") < 0, -slope).otherwise(slope)
    turn = F.degrees(F.atan(slope))
    return _with_moments(features).select(*features.columns, F.when(F.col("_xx") == 0, 0.0).otherwise(90 - turn).alias("ORIENT"))


# -- hulls, boxes and circles -----------------------------------------------------------------------------------


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise, first one not repeated (monotone chain)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def hulls(xy: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of features and their hulls' corners (feature, corner, axis), of all that have as many corners together.

    Feature i has the vertices starts[i] to starts[i + 1].  The chain of ``convex_hull`` runs over many features in step.
    """
    sizes = np.diff(starts)
    for m in np.unique(sizes):
        at = np.nonzero(sizes == m)[0]
        if len(at) < 4 or m < 3:  # as many vertices as few others
            for i in at:
                yield at[at == i], convex_hull(xy[starts[i] : starts[i + 1]]).reshape(1, -1, 2)
            continue
        p = xy[starts[at][:, None] + np.arange(m)]
        p = np.sort(p[..., 0] + 1j * p[..., 1], axis=1)  # by x, then y
        new = np.ones(p.shape, bool)
        new[:, 1:] = p[:, 1:] != p[:, :-1]
        line = new.sum(axis=1) < 3
        rows, out, n = np.arange(len(at)), np.zeros((len(at), 2 * m), complex), np.zeros(len(at), int)
        for order in (range(m), range(m - 1, -1, -1)):
            stack, top = np.zeros(p.shape, complex), np.zeros(len(at), int)
            for k in order:
                q, on = p[:, k], new[:, k]
                go = on & (top > 1)
                while go.any():
                    i = rows[go]
                    a, b, c = stack[i, top[i] - 2], stack[i, top[i] - 1], q[i]
                    gone = i[(b.real - a.real) * (c.imag - a.imag) - (b.imag - a.imag) * (c.real - a.real) <= 0]
                    top[gone] -= 1
                    go = np.zeros(len(at), bool)
                    go[gone] = top[gone] > 1
                stack[rows[on], top[on]] = q[on]
                top[on] += 1
            for k in range(top.max() - 1):
                i = rows[top - 1 > k]
                out[i, n[i]] = stack[i, k]
                n[i] += 1
        for i in rows[line]:  # two places or one
            own = p[i][new[i]]
            out[i, : len(own)], n[i] = own, len(own)
        for h in np.unique(n):
            some = out[n == h, :h]
            yield at[n == h], np.stack([some.real, some.imag], axis=-1)


def minimum_boxes(xy: np.ndarray, starts: np.ndarray, criterion: str = "area") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each feature the four corners of the least rectangle with a side on the hull, its short and long side, and the long side's azimuth."""
    count = len(starts) - 1
    corners, short, long, azimuth = np.zeros((count, 4, 2)), np.zeros(count), np.zeros(count), np.zeros(count)
    for at, hull in hulls(xy, starts):
        if hull.shape[1] < 2:
            corners[at] = hull if hull.shape[1] else 0.0
            continue
        x, y = hull[..., 0], hull[..., 1]
        edges = np.roll(hull, -1, axis=1) - hull
        angles = np.sort(np.mod(np.arctan2(edges[..., 1], edges[..., 0]), math.pi / 2).round(12), axis=1)
        best = np.full((len(at), 6), np.inf)
        for a in angles.T:
            c, s = np.cos(a)[:, None], np.sin(a)[:, None]
            u, v = x * c + y * s, y * c - x * s
            ends = [u.min(axis=1), u.max(axis=1), v.min(axis=1), v.max(axis=1)]
            w, h = ends[1] - ends[0], ends[3] - ends[2]
            size = {"area": w * h, "perimeter": w + h, "length": np.maximum(w, h), "width": np.minimum(w, h)}[criterion]
            better = size < best[:, 0] - 1e-9
            best[better] = np.column_stack([size, a, *ends])[better]
        _, a, u0, u1, v0, v1 = best.T
        c, s = np.cos(a), np.sin(a)
        corners[at] = np.stack([np.stack([u * c - v * s, u * s + v * c], axis=-1) for u, v in ((u0, v0), (u0, v1), (u1, v1), (u1, v0))], axis=1)
        w, h = u1 - u0, v1 - v0
        short[at], long[at] = np.minimum(w, h), np.maximum(w, h)
        azimuth[at] = (90 - np.degrees(np.where(w >= h, a, a + math.pi / 2))) % 180
    return corners, short, long, azimuth


def minimum_box(points: np.ndarray, criterion: str = "area") -> tuple[np.ndarray, float, float, float]:
    """``minimum_boxes`` of one feature."""
    return tuple(v[0] for v in minimum_boxes(points, np.array([0, len(points)]), criterion))


@lru_cache(1000)
def _shuffled(n: int) -> np.ndarray:
    return np.random.default_rng(0).permutation(n)


def enclosing_circle(points: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest circle around the points."""
    return _circle(convex_hull(points))


def _circle(p: np.ndarray) -> tuple[float, float, float]:
    if not len(p):
        return 0.0, 0.0, 0.0

    def of(*q) -> tuple[float, float, float]:
        if len(q) == 1:
            return q[0][0], q[0][1], 0.0
        if len(q) == 2:
            (ax, ay), (bx, by) = q
            return (ax + bx) / 2, (ay + by) / 2, math.hypot(ax - bx, ay - by) / 2
        (ax, ay), (bx, by), (cx, cy) = q
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if not d:
            return max((of(q[0], q[1]), of(q[0], q[2]), of(q[1], q[2])), key=lambda c: c[2])
        x, y = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return ax + x, ay + y, math.hypot(x, y)

    out = lambda c, q: math.hypot(q[0] - c[0], q[1] - c[1]) > c[2] * (1 + 1e-12) + 1e-12
    rows = p[_shuffled(len(p))].tolist()
    c = of(rows[0])
    for i, a in enumerate(rows):
        if out(c, a):
            c = of(a)
            for j, b in enumerate(rows[:i]):
                if out(c, b):
                    c = of(a, b)
                    for d in rows[:j]:
                        if out(c, d):
                            c = of(a, b, d)
    return c


def _closed(corners: np.ndarray) -> list[dict]:
    """A ring, clockwise and closed."""
    rows = corners.tolist()
    if len(rows) > 2 and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(rows, rows[1:] + rows[:1], strict=True)) > 0:
        rows = rows[::-1]
    return [{"x": x, "y": y} for x, y in [*rows, rows[0]]] if rows else []


def per_feature(features: DataFrame, kernel: Callable[[np.ndarray, list[int]], tuple], schema: str) -> DataFrame:
    """``kernel`` (points, parts) of every feature: its results as the columns of ``schema``, beside fid."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for points, parts in zip(batch.column("points").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                p = np.array([(q["x"], q["y"]) for q in points or ()], float).reshape(-1, 2)
                for to, v in zip(out, kernel(p, parts or []), strict=True):
                    to.append(v)
            kinds = [pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])) if "array" in c else pa.float64() for c in schema.split(", ")]
            yield pa.record_batch([batch.column("fid"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["fid", *names])

    ship(features.sparkSession)
    return features.select(F.col("fid").cast("long").alias("fid"), "points", "parts").mapInArrow(run, f"fid long, {schema}")


def per_batch(features: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """``kernel`` (vertices, starts) of a batch of features: the columns of ``schema``, beside fid.

    A column is an array of numbers, or for points a list of numbers of features and their points (feature, point, axis).
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def rings_of(groups: list[tuple[np.ndarray, np.ndarray]], count: int) -> pa.Array:
        sizes = np.zeros(count, np.int32)
        for at, p in groups:
            sizes[at] = p.shape[1]
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.zeros((starts[-1], 2))
        for at, p in groups:
            flat[starts[at][:, None] + np.arange(p.shape[1])] = p
        return pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("points")
            flat = own.flatten()  # without those of null features
            sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
            xy = np.column_stack([flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)]).astype(float)
            found = kernel(xy, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            columns = [rings_of(v, len(own)) if isinstance(v, list) else pa.array(v, pa.float64()) for v in found]
            yield pa.record_batch([batch.column("fid"), *columns], names=["fid", *names])

    ship(features.sparkSession)
    return features.select(F.col("fid").cast("long").alias("fid"), "points").mapInArrow(run, f"fid long, {schema}")


def _closed_all(corners: np.ndarray) -> np.ndarray:
    """Rings (feature, corner, axis), clockwise and closed."""
    if corners.shape[1] > 2:
        x, y = corners[..., 0], corners[..., 1]
        turned = (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1) > 0
        corners = np.where(turned[:, None, None], corners[:, ::-1], corners)
    return np.concatenate([corners, corners[:, :1]], axis=1)


def _layer(features: DataFrame) -> DataFrame:
    """One feature, fid 1, with the corners of the hull of all points."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hull = np.empty((0, 2))
        for batch in batches:
            own = np.column_stack([batch.column("x").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)])
            hull = convex_hull(np.concatenate([hull, own]))
        if len(hull):
            yield pa.record_batch([pa.array(hull[:, 0]), pa.array(hull[:, 1])], names=["x", "y"])

    ship(features.sparkSession)
    xy = features.select(F.explode("points").alias("p")).select("p.x", "p.y")
    few = xy.mapInArrow(corners, "x double, y double")  # a partition's hull corners only
    return few.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("points")).where("size(points) > 0").select(F.lit(1).cast("long").alias("fid"), F.lit(MULTIPOINT).alias("shape_type"), F.array(F.lit(0)).alias("parts"), "points")


def _polygons(found: DataFrame, *more: str) -> DataFrame:
    return found.select("fid", F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), "points", *more)


@tool("MinimumConvexHull", GIS)
def minimum_convex_hull(features: DataFrame, per: bool = True) -> DataFrame:
    """Convex hull of each feature, or of the layer."""
    kernel = lambda xy, starts: ([(at, _closed_all(h)) for at, h in hulls(xy, starts)],)
    return _polygons(per_batch(features if per else _layer(features), kernel, f"points {POINTS}"))


@tool("MinimumBoundingBox", GIS)
def minimum_bounding_box(features: DataFrame, criterion: str = "area", per: bool = True) -> DataFrame:
    """Least rectangle, of any direction, around each feature or the layer; with its short and long side."""

    def kernel(xy, starts):
        corners, short, long, _ = minimum_boxes(xy, starts, criterion)
        return [(np.arange(len(short)), _closed_all(corners))], short, long

    return _polygons(per_batch(features if per else _layer(features), kernel, f"points {POINTS}, short_axis double, long_axis double"), "short_axis", "long_axis")


@tool("MinimumBoundingCircle", GIS)
def minimum_bounding_circle(features: DataFrame, per: bool = True) -> DataFrame:
    """Smallest circle around each feature or the layer: centre, radius, and a ring of 128 corners."""

    def kernel(xy, starts):
        found = np.zeros((len(starts) - 1, 3))
        for at, hull in hulls(xy, starts):
            found[at] = [_circle(h) for h in hull]
        return tuple(found.T)

    found = per_batch(features if per else _layer(features), kernel, "x double, y double, radius double")
    turn = lambda k: F.lit(2 * math.pi / 128) * ((127 - k) % 128)  # noqa: E731  clockwise
    ring = F.transform(F.sequence(F.lit(0), F.lit(128)), lambda k: F.struct((F.col("x") + F.col("radius") * F.cos(turn(k % 128))).alias("x"), (F.col("y") + F.col("radius") * F.sin(turn(k % 128))).alias("y")))
    return _polygons(found.withColumn("points", ring), "x", "y", "radius")


def _rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))])


def _bounds(points: str = "points") -> list[Column]:
    along = lambda c: F.transform(points, lambda q: q[c])
    return [F.array_min(along("x")), F.array_min(along("y")), F.array_max(along("x")), F.array_max(along("y"))]


@tool("MinimumBoundingEnvelope", GIS)
def minimum_bounding_envelope(features: DataFrame, per: bool = True) -> DataFrame:
    """Upright rectangle around each feature or the layer."""
    x0, y0, x1, y1 = _bounds()
    if per:
        return features.select("fid", F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), _rectangle(x0, y0, x1, y1).alias("points"))
    return layer_footprint(features)


@tool("LayerFootprint", GIS)
def layer_footprint(features: DataFrame) -> DataFrame:
    """One rectangle around all features."""
    x0, y0, x1, y1 = _bounds()
    all_ = features.agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")).where("x0 is not null")
    return all_.select(F.lit(1).cast("long").alias("fid"), F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), _rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("points"))


@tool("LidarTileFootprint", "LiDAR Tools")
def lidar_tile_footprint(points: DataFrame, hull: bool = False) -> DataFrame:
    """Envelope or convex hull of each file's points; corners are combined before they meet."""
    if not hull:
        box = points.groupBy("file").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
        return box.select("file", F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), _rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("points"))

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hulls: dict = {}
        for batch in batches:
            files = np.array(batch.column("file").to_pylist(), object)
            xy = np.column_stack([batch.column("x").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)])
            for f in set(files):
                hulls[f] = convex_hull(np.concatenate([hulls.get(f, np.empty((0, 2))), xy[files == f]]))
        rows = [(f, x, y) for f, h in hulls.items() for x, y in h.tolist()]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.float64()) for i in (1, 2))], names=["file", "x", "y"])

    ship(points.sparkSession)
    few = points.select("file", "x", "y").mapInArrow(corners, "file string, x double, y double")
    rows = few.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("points")).withColumns({"fid": F.xxhash64("file"), "parts": F.array(F.lit(0))})
    return rows.select("file", "fid").join(per_feature(rows, lambda p, _: (_closed(convex_hull(p)),), f"points {POINTS}"), "fid").select("file", F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), "points")


def _hulls(p: np.ndarray, parts: list[int]) -> list[np.ndarray]:
    ends = [*parts[1:], len(p)]
    out = []
    for i, (a, b) in enumerate(zip(parts, ends, strict=True)):
        r = p[a:b]
        ccw = (r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() > 0
        if not i or not ccw:
            out.append(r)
    return out


def _joined(features: DataFrame, found: DataFrame) -> DataFrame:
    return features.join(found, "fid")


def _ring_area(r: np.ndarray) -> float:
    q = np.roll(r, -1, axis=0)
    return abs(float((r[:, 0] * q[:, 1] - q[:, 0] * r[:, 1]).sum())) / 2


@tool("ShapeComplexityIndex", SHAPE)
def shape_complexity_index(features: DataFrame) -> DataFrame:
    """1 - area / area of the hulls' convex hulls."""
    found = per_feature(features, lambda p, parts: (sum(_ring_area(convex_hull(r)) for r in _hulls(p, parts)),), "_hull double")
    return _joined(features, found).select(*features.columns, (1 - area() / F.nullif(F.col("_hull"), F.lit(0.0))).alias("COMPLEXITY"))


@tool("RelatedCircumscribingCircle", SHAPE)
def related_circumscribing_circle(features: DataFrame) -> DataFrame:
    """1 - area / area of the hulls' smallest enclosing circles."""
    found = per_feature(features, lambda p, parts: (sum(math.pi * enclosing_circle(r)[2] ** 2 for r in _hulls(p, parts)),), "_circle double")
    return _joined(features, found).select(*features.columns, (1 - area() / F.nullif(F.col("_circle"), F.lit(0.0))).alias("RC_CIRCLE"))


@tool("ElongationRatio", SHAPE)
def elongation_ratio(features: DataFrame) -> DataFrame:
    """1 - short side / long side of the minimum bounding box."""
    found = per_batch(features, lambda xy, starts: minimum_boxes(xy, starts)[1:3], "_short double, _long double")
    return _joined(features, found).select(*features.columns, (1 - F.col("_short") / F.nullif(F.col("_long"), F.lit(0.0))).alias("ELONGATION"))


def _axis(features: DataFrame, long: bool) -> DataFrame:
    def kernel(xy, starts):
        corners = minimum_boxes(xy, starts)[0]
        mid = (corners + np.roll(corners, -1, axis=1)) / 2
        one, two = mid[:, (0, 2)], mid[:, (1, 3)]
        far = lambda p: np.hypot(*(p[:, 0] - p[:, 1]).T)
        ends = np.where(((far(one) >= far(two)) == long)[:, None, None], one, two)
        back = (ends[:, 0, 0] > ends[:, 1, 0]) | ((ends[:, 0, 0] == ends[:, 1, 0]) & (ends[:, 0, 1] > ends[:, 1, 1]))
        return ([(np.arange(len(ends)), np.where(back[:, None, None], ends[:, ::-1], ends))],)

    return per_batch(features, kernel, f"points {POINTS}").select("fid", F.lit(LINE).alias("shape_type"), F.array(F.lit(0)).alias("parts"), "points")


@tool("PolygonLongAxis", GIS)
def polygon_long_axis(features: DataFrame) -> DataFrame:
    """The long axis of the minimum bounding box as a line."""
    return _axis(features, True)


@tool("PolygonShortAxis", GIS)
def polygon_short_axis(features: DataFrame) -> DataFrame:
    """The short axis of the minimum bounding box as a line."""
    return _axis(features, False)


@tool("DeviationFromRegionalDirection", SHAPE)
def deviation_from_regional_direction(features: DataFrame, elong_threshold: float = 0.75) -> DataFrame:
    """Angle, 0 to 90, between each polygon's long axis and the mean direction weighted by elongation and long side."""
    found = per_batch(features, lambda xy, starts: minimum_boxes(xy, starts)[1:], "_short double, _long double, _turn double")
    e = 1 - F.col("_short") / F.nullif(F.col("_long"), F.lit(0.0))
    turn = F.radians(2 * F.col("_turn"))
    w = F.when(e >= elong_threshold, e * F.col("_long")).otherwise(0.0)
    mean = found.agg(F.sum(w * F.sin(turn)).alias("s"), F.sum(w * F.cos(turn)).alias("c")).select(F.pmod(F.degrees(F.atan2("s", "c")) / 2, F.lit(180.0)).alias("_mean"))
    d = F.abs(F.col("_turn") - F.col("_mean"))
    return _joined(features, found).crossJoin(F.broadcast(mean)).select(*features.columns, F.when(d > 90, 180 - d).otherwise(d).alias("DEV_DIR"))  # the mean is one row


# -- points and tables ------------------------------------------------------------------------------------------


@tool("AddPointCoordinatesToTable", DATA)
def add_point_coordinates(features: DataFrame) -> DataFrame:
    """Columns XCOORD and YCOORD of point features."""
    return features.withColumns({"XCOORD": F.get("points", F.lit(0))["x"], "YCOORD": F.get("points", F.lit(0))["y"]})


@tool("CleanVector", DATA)
def clean_vector(features: DataFrame) -> DataFrame:
    """Drops null features and parts with too few vertices (2 in a line, 3 distinct corners and the end in a polygon)."""
    least = F.when(F.col("shape_type") == POLYGON, 4).when(F.col("shape_type") == LINE, 2).otherwise(1)
    good = features.where("shape_type <> 0 and size(points) > 0").withColumn("_rings", F.filter(rings(), lambda r: F.size(r) >= least)).where("size(_rings) > 0")
    return _from_rings(good, features.columns)


def _from_rings(df: DataFrame, columns: list[str]) -> DataFrame:
    """parts and points set from the column _rings."""
    starts = F.transform(F.col("_rings"), lambda r, i: F.aggregate(F.slice("_rings", 1, i), F.lit(0), lambda s, q: s + F.size(q)))
    return df.select(*[{"parts": starts.alias("parts"), "points": F.flatten("_rings").alias("points")}.get(c, F.col(f"`{c}`")) for c in columns])


@tool("LinesToPolygons", DATA)
def lines_to_polygons(features: DataFrame) -> DataFrame:
    """Lines closed to rings: the first part of a feature clockwise, its other parts as holes."""
    closed = F.transform(rings(), lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    turned = F.transform(closed, lambda r, i: F.when((signed_area(r) > 0) == (i > 0), r).otherwise(F.reverse(r)))
    return _from_rings(features.where("size(points) > 0").withColumn("_rings", turned), features.columns).withColumn("shape_type", F.lit(POLYGON))


@tool("PolygonsToLines", DATA)
def polygons_to_lines(features: DataFrame) -> DataFrame:
    """Rings as line parts."""
    return features.withColumn("shape_type", F.lit(LINE))


@tool("RemovePolygonHoles", DATA)
def remove_polygon_holes(features: DataFrame) -> DataFrame:
    """Polygons without their counter-clockwise later rings."""
    return _from_rings(features.withColumn("_rings", F.filter(rings(), lambda r, i: (i == 0) | (signed_area(r) <= 0))), features.columns)


@tool("MultiPartToSinglePart", DATA)
def multipart_to_singlepart(features: DataFrame, exclude_holes: bool = False) -> DataFrame:
    """One feature a part; fid becomes the parent's, part the part's number.  Holes go if asked."""
    keep = [c for c in features.columns if c not in FEATURE]
    one = features.select("fid", "shape_type", F.posexplode(rings()).alias("part", "points"), *keep)
    if exclude_holes:
        one = one.where((F.col("part") == 0) | (F.col("shape_type") != POLYGON) | (signed_area(F.col("points")) <= 0))
    return one.select("fid", "part", "shape_type", F.array(F.lit(0)).alias("parts"), "points", *keep)


@tool("SinglePartToMultiPart", DATA)
def singlepart_to_multipart(features: DataFrame, field: str) -> DataFrame:
    """Features of one attribute value joined into one, parts in the order of fid."""
    rows = features.withColumn("_rings", rings()).withColumn("_points", F.flatten("_rings"))
    # where a feature's points begin is summed before features meet, so a part isn't counted again for each after it
    before = W.partitionBy(field).orderBy("fid", "_rings").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.size("_points")).over(before), F.lit(0)).cast("int"))
    rows = rows.withColumn("_parts", F.transform("parts", lambda p: p - F.get("parts", F.lit(0)) + F.col("_start")))
    met = rows.groupBy(field).agg(F.min("fid").alias("fid"), F.first("shape_type").alias("shape_type"), F.array_sort(F.collect_list(F.struct("_start", "fid", "_parts", "_points"))).alias("own"))
    whole = lambda c: F.flatten(F.transform("own", lambda x: x[c]))
    return met.select("fid", "shape_type", whole("_parts").alias("parts"), whole("_points").alias("points"), field)


@tool("MergeVectors", DATA)
def merge_vectors(layers: dict[str, DataFrame]) -> DataFrame:
    """Features of several layers with the attributes that all have, and PARENT, the layer's name."""
    names = list(layers)
    shared = [c for c in layers[names[0]].columns if all(c in layers[n].columns for n in names)]
    out = None
    for n in names:
        own = layers[n].select(*shared, F.lit(n).alias("PARENT"))
        out = own if out is None else out.unionByName(own)
    return out


@tool("ReinitializeAttributeTable", DATA)
def reinitialize_attribute_table(features: DataFrame) -> DataFrame:
    """Only the shape and fid."""
    return features.select(*FEATURE)


@tool("JoinTables", DATA)
def join_tables(left: DataFrame, pkey: str, right: DataFrame, fkey: str, import_fields: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Left outer join on keys as text; of equal foreign keys the last row (greatest ``order``, or all columns) wins."""
    fields = import_fields or [c for c in right.columns if c != fkey]
    key = F.col(fkey).cast("string")
    last = right.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*fields), F.struct(*([order] if order else right.columns))).alias("_row"))
    return left.join(last, left[pkey].cast("string") == F.col("_key"), "left").select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in fields])


register("MergeTableWithCsv", DATA, join_tables, "Left outer join with a table read from CSV.")


@tool("CsvPointsToVector", DATA)
def csv_points_to_vector(spark, path: str, xfield: int = 0, yfield: int = 1, schema: str | None = None) -> DataFrame:
    """A CSV file with a header as point features; types are read from the data if no schema is given."""
    rows = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    x, y = (F.col(f"`{rows.columns[i]}`").cast("double") for i in (xfield, yfield))
    return rows.select(F.xxhash64(*rows.columns).alias("fid"), F.lit(POINT).alias("shape_type"), F.array(F.lit(0)).alias("parts"), F.array(F.struct(x.alias("x"), y.alias("y"))).alias("points"), *[F.col(f"`{c}`") for c in rows.columns])


@tool("ExportTableToCsv", DATA)
def export_table_to_csv(features: DataFrame, path: str, headers: bool = True) -> None:
    """Attributes as CSV."""
    features.drop("shape_type", "parts", "points").write.csv(path, header=headers, mode="overwrite")


@tool("ExtractByAttribute", "Plug-ins")
def extract_by_attribute(features: DataFrame, statement: str) -> DataFrame:
    """Features whose attributes meet a SQL condition."""
    return features.where(statement)


@tool("ExtractNodes", GIS)
def extract_nodes(features: DataFrame) -> DataFrame:
    """Every vertex as a point: fid of its feature, its number there, x and y."""
    return features.select("fid", F.posexplode("points").alias("node", "p")).select("fid", "node", "p.x", "p.y")


@tool("CentroidVector", GIS)
def centroid_vector(features: DataFrame) -> DataFrame:
    """Mean of the vertices of each feature."""
    n = F.size("points")
    mean = lambda c: _total(F.transform("points", lambda p: p[c])) / F.nullif(n, F.lit(0))
    return features.select("fid", mean("x").alias("x"), mean("y").alias("y"))


@tool("Medoid", GIS)
def medoid(features: DataFrame) -> DataFrame:
    """The vertex of each feature nearest to its median x and y (the upper of two middle values)."""
    mid = lambda c: F.get(F.array_sort(F.transform("points", lambda p: p[c])), F.floor(F.size("points") / 2).cast("int"))
    m = features.where("size(points) > 0").withColumns({"_x": mid("x"), "_y": mid("y")})
    near = F.array_min(F.transform("points", lambda p: F.struct(((p["x"] - F.col("_x")) ** 2 + (p["y"] - F.col("_y")) ** 2).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))
    return m.select("fid", near.alias("near")).select("fid", "near.x", "near.y")


@tool("SmoothVectors", GIS)
def smooth_vectors(features: DataFrame, filter_size: int = 3) -> DataFrame:
    """Moving average along each part, the window clipped to it; a line's ends stay."""
    half = max(3, filter_size + 1 - filter_size % 2) // 2
    one = features.select("fid", "shape_type", F.posexplode(rings()).alias("part", "ring"))
    one = one.select("fid", "shape_type", "part", F.size("ring").alias("n"), F.posexplode("ring").alias("k", "p"))
    w = W.partitionBy("fid", "part").orderBy("k").rowsBetween(-half, half)
    pinned = (F.col("shape_type") == LINE) & ((F.col("k") == 0) | (F.col("k") == F.col("n") - 1))
    value = lambda c: F.when(pinned, F.col(f"p.{c}")).otherwise(F.avg(f"p.{c}").over(w)).alias(c)
    return one.select("fid", "part", "k", value("x"), value("y"))


@tool("EliminateCoincidentPoints", GIS)
def eliminate_coincident_points(points: DataFrame, tolerance: float) -> DataFrame:
    """Points (fid, x, y) without those that lie within a distance of one with a smaller fid."""
    near = neighbours(points.select("fid", "x", "y"), points.select("fid", "x", "y"), tolerance).where("fid > other_fid").select("fid").distinct()
    return points.join(near, "fid", "left_anti")


def neighbours(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Each row of ``a`` with every row of ``b`` within a distance; b's columns are prefixed with other_.

    Rows of b go to the nine buckets around them, so the join is an equality; buckets are a radius wide.
    """
    size = float(radius) if radius > 0 else 1.0
    bucket = lambda c: F.floor(F.col(c) / size)
    left = a.withColumns({"_bx": bucket("x"), "_by": bucket("y")})
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    right = b.select(*[F.col(c).alias(f"other_{c}") for c in b.columns], bucket("x").alias("_x"), bucket("y").alias("_y")).withColumn("_i", step).withColumn("_j", step)
    right = right.withColumns({"_bx": F.col("_x") + F.col("_i"), "_by": F.col("_y") + F.col("_j")}).drop("_x", "_y", "_i", "_j")
    d = F.sqrt((F.col("x") - F.col("other_x")) ** 2 + (F.col("y") - F.col("other_y")) ** 2)
    return left.join(right, ["_bx", "_by"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("_bx", "_by")


def inside(x: Column, y: Column, ring_points: Column) -> Column:
    """Whether a point is within a ring, by crossings of a ray."""
    n = F.greatest(F.size(ring_points) - 1, F.lit(0))
    crossed = F.zip_with(F.slice(ring_points, 1, n), F.slice(ring_points, 2, n), lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(crossed, lambda c: c)) % 2 == 1


def contained(points: DataFrame, polygons: DataFrame, key: str, cell: float | None = None) -> DataFrame:
    """key and fid: the points (key, x, y) that lie in each polygon; holes don't count.

    Buckets are ``cell`` wide, by default the mean envelope of the polygons, so a polygon covers a few.
    """
    x0, y0, x1, y1 = _bounds()
    boxed = polygons.select("fid", rings().alias("rings"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    if cell is None:
        cell = boxed.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    b = lambda c: F.floor(F.col(c) / float(cell))
    spread = boxed.withColumn("_bx", F.explode(F.sequence(b("x0"), b("x1")))).withColumn("_by", F.explode(F.sequence(b("y0"), b("y1"))))
    own = points.select(key, "x", "y").withColumns({"_bx": b("x"), "_by": b("y")})
    crossings = F.aggregate("rings", F.lit(False), lambda s, r: s != inside(F.col("x"), F.col("y"), r))
    met = own.join(spread, ["_bx", "_by"]).where((F.col("x").between(F.col("x0"), F.col("x1"))) & F.col("y").between(F.col("y0"), F.col("y1")) & crossings)
    return met.select(key, "fid")


def _centres(cells: DataFrame, north: float, west: float, resolution: float) -> DataFrame:
    return cells.select(F.struct("row", "col").alias("at"), (west + (F.col("col") + 0.5) * resolution).alias("x"), (north - (F.col("row") + 0.5) * resolution).alias("y"))


@tool("ClipRasterToPolygon", GIS)
def clip_raster_to_polygon(cells: DataFrame, polygons: DataFrame, north: float = 0.0, west: float = 0.0, resolution: float = 1.0, maintain_dimensions: bool = True) -> DataFrame:
    """Cells whose centres lie in no polygon become NoData, or go if the raster is cropped."""
    met = contained(_centres(cells, north, west, resolution), polygons, "at").select("at.row", "at.col", F.lit(True).alias("_in")).distinct()
    if not maintain_dimensions:
        return cells.join(met, ["row", "col"]).select("row", "col", "value")
    return cells.join(met, ["row", "col"], "left").select("row", "col", F.when(F.col("_in"), F.col("value")).alias("value"))


@tool("ErasePolygonFromRaster", GIS)
def erase_polygon_from_raster(cells: DataFrame, polygons: DataFrame, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Cells whose centres lie in a polygon become NoData."""
    met = contained(_centres(cells, north, west, resolution), polygons, "at").select("at.row", "at.col", F.lit(True).alias("_in")).distinct()
    return cells.join(met, ["row", "col"], "left").select("row", "col", F.when(F.col("_in").isNull(), F.col("value")).alias("value"))


@tool("VectorPolygonsToRaster", DATA)
def vector_polygons_to_raster(polygons: DataFrame, base: DataFrame, field: str = "fid", north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """The field of the polygon (of greatest fid) that a cell's centre lies in; NoData in none."""
    met = contained(_centres(base, north, west, resolution), polygons, "at")
    if field != "fid":
        met = met.join(polygons.select("fid", F.col(field).cast("double").alias("_v")), "fid")
    else:
        met = met.withColumn("_v", F.col("fid").cast("double"))
    top = met.groupBy("at").agg(F.max_by("_v", "fid").alias("value")).select("at.row", "at.col", "value")
    return base.select("row", "col").join(top, ["row", "col"], "left")


# -- points to rasters and back ---------------------------------------------------------------------------------


def cell_of(points: DataFrame, north: float, west: float, resolution: float) -> DataFrame:
    return points.withColumns({"row": F.floor((F.lit(north) - F.col("y")) / resolution).cast("int"), "col": F.floor((F.col("x") - west) / resolution).cast("int")})


@tool("RasterToVectorPoints", DATA)
def raster_to_vector_points(cells: DataFrame, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """A point at the centre of every cell that is neither 0 nor NoData."""
    at = cells.where("value is not null and value <> 0")
    return at.select((F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")).alias("fid"), (west + (F.col("col") + 0.5) * resolution).alias("x"), (north - (F.col("row") + 0.5) * resolution).alias("y"), F.col("value").alias("VALUE"))


@tool("VectorPointsToRaster", DATA)
def vector_points_to_raster(points: DataFrame, field: str = "fid", assign: str = "last", north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Points (fid, x, y and a field) by cell: first, last, min, max, sum or number."""
    v = F.col(field).cast("double")
    how = {"first": F.min_by(v, "fid"), "last": F.max_by(v, "fid"), "min": F.min(v), "max": F.max(v), "sum": F.sum(v), "number": F.count("*").cast("double")}[assign]
    return cell_of(points, north, west, resolution).groupBy("row", "col").agg(how.alias("value"))


@tool("BlockMaximumGridding", GIS)
def block_maximum_gridding(points: DataFrame, field: str, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Greatest value of the points in each cell."""
    return cell_of(points, north, west, resolution).groupBy("row", "col").agg(F.max(field).cast("double").alias("value"))


@tool("BlockMinimumGridding", GIS)
def block_minimum_gridding(points: DataFrame, field: str, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Least value of the points in each cell."""
    return cell_of(points, north, west, resolution).groupBy("row", "col").agg(F.min(field).cast("double").alias("value"))


def _near_points(base: DataFrame, points: DataFrame, radius: float, north: float, west: float, resolution: float) -> DataFrame:
    centres = base.select("row", "col", (west + (F.col("col") + 0.5) * resolution).alias("x"), (north - (F.col("row") + 0.5) * resolution).alias("y"))
    return neighbours(centres, points, radius)


@tool("IdwInterpolation", GIS)
def idw_interpolation(points: DataFrame, base: DataFrame, field: str, radius: float, weight: float = 2.0, min_points: int = 0, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Inverse-distance weighted mean of the points within a radius; a point at the centre gives its own value."""
    own = points.select("x", "y", F.col(field).cast("double").alias("v"))
    met = _near_points(base, own, radius, north, west, resolution)
    w = F.pow("dist", F.lit(-float(weight)))
    got = met.groupBy("row", "col").agg(F.avg(F.when(F.col("dist") == 0, F.col("other_v"))).alias("here"), (F.sum(F.when(F.col("dist") > 0, w * F.col("other_v"))) / F.sum(F.when(F.col("dist") > 0, w))).alias("mean"), F.count("*").alias("n"))
    value = got.select("row", "col", F.when(F.col("n") >= min_points, F.coalesce("here", "mean")).alias("value"))
    return base.select("row", "col").join(value, ["row", "col"], "left")


@tool("NearestNeighbourGridding", GIS)
def nearest_neighbour_gridding(points: DataFrame, base: DataFrame, field: str, max_dist: float, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Value of the nearest point within a distance; ties by the smaller x, y, then value."""
    own = points.select("x", "y", F.col(field).cast("double").alias("v"))
    met = _near_points(base, own, max_dist, north, west, resolution)
    got = met.groupBy("row", "col").agg(F.min_by("other_v", F.struct("dist", "other_x", "other_y", "other_v")).alias("value"))
    return base.select("row", "col").join(got, ["row", "col"], "left")


@tool("HeatMap", "Plug-ins")
def heat_map(points: DataFrame, base: DataFrame, bandwidth: float, field: str | None = None, north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Kernel density of the points by the quartic kernel, 0 where none is near."""
    own = points.select("x", "y", (F.col(field).cast("double") if field else F.lit(1.0)).alias("v"))
    met = _near_points(base, own, bandwidth, north, west, resolution)
    u = F.col("dist") / float(bandwidth)
    got = met.groupBy("row", "col").agg(F.sum(F.col("other_v") * 15 / 16 * (1 - u * u) ** 2).alias("v"))
    return base.select("row", "col").join(got, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("value"))


@tool("ExtractRasterValuesAtPoints", GIS)
def extract_raster_values(points: DataFrame, rasters: list[DataFrame], north: float = 0.0, west: float = 0.0, resolution: float = 1.0) -> DataFrame:
    """Columns VALUE1, VALUE2, ... of each raster's cell under a point."""
    out = cell_of(points, north, west, resolution)
    for i, cells in enumerate(rasters, 1):
        out = out.join(cells.select("row", "col", F.col("value").alias(f"VALUE{i}")), ["row", "col"], "left")
    return out.select(*points.columns, *[f"VALUE{i}" for i in range(1, len(rasters) + 1)])


@tool("RasterPerimeter", GIS)
def raster_perimeter(cells: DataFrame, zero_back: bool = False) -> DataFrame:
    """Number of cell sides on the boundary of each class."""
    own = cells.where("value is not null and value <> 0" if zero_back else "value is not null").select("row", "col", "value")
    sides = own.withColumn("s", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))])))
    other = own.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("value").alias("v2"))
    met = sides.withColumns({"row2": F.col("row") + F.col("s.r"), "col2": F.col("col") + F.col("s.c")}).join(other, ["row2", "col2"], "left")
    return met.where("v2 is null or v2 <> value").groupBy("value").agg(F.count("*").alias("perimeter"))


@tool("CreateRectangularVectorGrid", GIS)
def create_rectangular_vector_grid(features: DataFrame, width: float, height: float, xorig: float = 0.0, yorig: float = 0.0) -> DataFrame:
    """Rectangles that cover the features' extent."""
    x0, y0, x1, y1 = _bounds()
    box = features.agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")).where("x0 is not null")
    at = lambda c, o, s: F.floor((F.col(c) - o) / s)
    rows = box.withColumn("i", F.explode(F.sequence(at("y0", yorig, height), at("y1", yorig, height)))).withColumn("j", F.explode(F.sequence(at("x0", xorig, width), at("x1", xorig, width))))
    x, y = xorig + F.col("j") * width, yorig + F.col("i") * height
    return rows.select("i", "j", F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), _rectangle(x, y, x + width, y + height).alias("points"))


def hexagon_of(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon, flat sides left and right, that a point lies in."""
    size = width / math.sqrt(3)
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size, (2 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when((dr > ds) & ~((dq > dr) & (dq > ds)), -rq - rs).otherwise(rr).cast("long")


def hexagon_ring(q: Column, r: Column, width: float) -> Column:
    size = width / math.sqrt(3)
    cx, cy = size * math.sqrt(3) * (q + r / 2), size * 1.5 * r
    corner = lambda k: F.struct((cx + size * math.sin(math.pi / 3 * k)).alias("x"), (cy + size * math.cos(math.pi / 3 * k)).alias("y"))
    return F.array(*[corner(k) for k in (0, 1, 2, 3, 4, 5, 0)])


@tool("VectorHexBinning", GIS)
def vector_hex_binning(points: DataFrame, width: float, orientation: str = "horizontal") -> DataFrame:
    """Hexagons that hold points (x, y), with their number."""
    x, y = (F.col("x"), F.col("y")) if orientation == "horizontal" else (F.col("y"), F.col("x"))
    q, r = hexagon_of(x, y, width)
    got = points.groupBy(q.alias("q"), r.alias("r")).agg(F.count("*").alias("COUNT"))
    ring = hexagon_ring(F.col("q"), F.col("r"), width)
    if orientation != "horizontal":
        ring = F.transform(ring, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))
    return got.select("q", "r", F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), ring.alias("points"), "COUNT")


@tool("CreateHexagonalVectorGrid", GIS)
def create_hexagonal_vector_grid(features: DataFrame, width: float) -> DataFrame:
    """Hexagons whose centres lie in the features' extent, widened by one width."""
    x0, y0, x1, y1 = _bounds()
    box = features.agg(F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")).where("x0 is not null")
    high = width * math.sqrt(3) / 2
    rows = box.withColumn("r", F.explode(F.sequence(F.floor((F.col("y0") - width) / high), F.ceil((F.col("y1") + width) / high))))
    rows = rows.withColumn("q", F.explode(F.sequence(F.ceil((F.col("x0") - width) / width - F.col("r") / 2), F.floor((F.col("x1") + width) / width - F.col("r") / 2))))
    return rows.select("q", "r", F.lit(POLYGON).alias("shape_type"), F.array(F.lit(0)).alias("parts"), hexagon_ring(F.col("q"), F.col("r"), width).alias("points"))
