"""Geometry kernels against literal answers and brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terracell.operators import vector as ve


def test_convex_hull_literals():
    points = [(i, s * i) for i in range(1, 10) for s in (1, -1, 0)] + [(0, 0)]
    assert {tuple(p) for p in ve.convex_hull(np.array(points, float))} == {(9, -9), (9, 9), (0, 0)}


def test_minimum_box_literals():
    points = np.array([(10, 10), (10, -10), (-10, 10), (-10, -10), (0, 0), (1, 1), (15, 15), (-15, -15)], float)
    corners, _, _, _ = ve.minimum_box(points)
    want = [(15, 15), (19.615, -8.077), (-15, -15), (-19.615, 8.077)]
    for w in want:
        assert min(np.hypot(*(corners - w).T)) < 0.01


def test_enclosing_circle_literals():
    x, y, r = ve.enclosing_circle(np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (0.5, 1.5)], float))
    assert (x, y, r) == pytest.approx((1, 1, math.sqrt(2)))


grid = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1, max_size=25)


@given(grid)
@settings(max_examples=150, deadline=None)
def test_hull_box_and_circle_hold_every_point(points):
    p = np.array(points, float)
    hull = ve.convex_hull(p)
    if len(hull) > 2:
        nxt = np.roll(hull, -1, axis=0)
        for q in p:
            assert ((nxt - hull)[:, 0] * (q - hull)[:, 1] - (nxt - hull)[:, 1] * (q - hull)[:, 0] >= -1e-9).all()
    x, y, r = ve.enclosing_circle(p)
    assert (np.hypot(p[:, 0] - x, p[:, 1] - y) <= r + 1e-7).all()
    _, short, long, _ = ve.minimum_box(p)
    assert short <= long + 1e-9 and long <= 2 * r + 1e-7


def feature(spark, *polygon_rings):
    points = [p for ring in polygon_rings for p in ring]
    starts = [sum(len(r) for r in polygon_rings[:i]) for i in range(len(polygon_rings))]
    return spark.createDataFrame([(1, 5, starts, points)], f"fid long, shape_type int, parts array<int>, points {ve.POINTS}")


SQUARE = [(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (5.0, 0.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]


def test_measures(spark):
    f = feature(spark, SQUARE, HOLE)
    r = f.select(ve.area().alias("a"), ve.perimeter().alias("p")).first()
    assert (r["a"], r["p"]) == (24.0, 24.0)
    assert ve.remove_polygon_holes(f).select(ve.area()).first()[0] == 25.0
    assert [x["part"] for x in ve.multipart_to_singlepart(f, exclude_holes=True).collect()] == [0]


def test_points_in_polygons_equal_brute_force(spark):
    rng = random.Random(0)
    shapes = []
    for i in range(12):
        cx, cy, n = rng.uniform(0, 40), rng.uniform(0, 40), rng.randint(3, 9)
        ring = [(cx + (2 + 6 * rng.random()) * math.cos(2 * math.pi * k / n), cy + (2 + 6 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        shapes.append((i, 5, [0], [*ring, ring[0]]))
    polygons = spark.createDataFrame(shapes, f"fid long, shape_type int, parts array<int>, points {ve.POINTS}")
    points = [(i, rng.uniform(-5, 45), rng.uniform(-5, 45)) for i in range(800)]

    def within(x, y, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    want = {(i, s[0]) for i, x, y in points for s in shapes if within(x, y, s[3])}
    for cell in (None, 1.7):
        got = ve.contained(spark.createDataFrame(points, "pid long, x double, y double"), polygons, "pid", cell).collect()
        assert {(r["pid"], r["fid"]) for r in got} == want and len(got) == len(want)


def test_radius_search_literals(spark):
    cloud = spark.createDataFrame([(1, 40.0, 32.0), (2, 25.0, 65.0), (3, 42.0, 35.0), (4, 40.0, 31.0), (5, 24.0, 68.0)], "pid long, x double, y double")
    at = spark.createDataFrame([(9, 40.5, 31.5)], "pid long, x double, y double")
    got = {(r["other_pid"], round(r["dist"], 8)) for r in ve.neighbours(at, cloud, 0.75).collect()}
    assert got == {(4, 0.70710678), (1, 0.70710678)}


def test_hexagons_take_the_nearest_centre(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(300)]
    q, r = ve.hexagon_of(F.col("x"), F.col("y"), 4.0)
    got = spark.createDataFrame(rows, "pid long, x double, y double").select("x", "y", q.alias("q"), r.alias("r")).collect()
    size = 4.0 / math.sqrt(3)
    centre = lambda q, r: (size * math.sqrt(3) * (q + r / 2), size * 1.5 * r)
    for p in got:
        own = math.dist((p["x"], p["y"]), centre(p["q"], p["r"]))
        assert all(own <= math.dist((p["x"], p["y"]), centre(p["q"] + a, p["r"] + b)) + 1e-9 for a in (-1, 0, 1) for b in (-1, 0, 1))
