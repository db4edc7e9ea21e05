"""Hulls, boxes and circles of many features at once, and features joined to one, against one at a time."""

import math
import random

import numpy as np
import pytest

from terracell.operators import vector as ve


def shapes(seed, n=60):
    """Features of 0 to 9 vertices on a coarse grid: repeated, in line, one place only."""
    rng = np.random.default_rng(seed)
    return [rng.integers(0, rng.choice((1, 2, 4, 9)), (rng.integers(0, 10), 2)) / 2.0 for _ in range(n)]


def packed(found):
    return np.concatenate([p.reshape(-1, 2) for p in found]), np.concatenate([[0], np.cumsum([len(p) for p in found])])


@pytest.mark.parametrize("seed", range(5))
def test_hulls_of_many_features(seed):
    found = shapes(seed)
    got = {int(i): h for at, hull in ve.hulls(*packed(found)) for i, h in zip(at, hull, strict=True)}
    assert sorted(got) == list(range(len(found)))
    for i, p in enumerate(found):
        assert got[i].tolist() == ve.convex_hull(p.reshape(-1, 2)).tolist()


@pytest.mark.parametrize("criterion", ["area", "perimeter", "length", "width"])
def test_boxes_of_many_features(criterion):
    found = shapes(9)
    corners, short, long, _ = ve.minimum_boxes(*packed(found), criterion)
    for p, c, s, t in zip(found, corners, short, long, strict=True):
        best = 0.0
        if len(np.unique(p, axis=0)) > 1:
            sizes = []
            hull = ve.convex_hull(p)
            for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
                u = (b - a) / np.hypot(*(b - a))
                w, h = np.ptp(p @ u), np.ptp(p @ (-u[1], u[0]))
                sizes.append({"area": w * h, "perimeter": w + h, "length": max(w, h), "width": min(w, h)}[criterion])
            best = min(sizes)
        own = {"area": s * t, "perimeter": s + t, "length": t, "width": s}[criterion]
        assert own == pytest.approx(best, abs=1e-9) and s <= t
        assert sorted(np.hypot(*(c - np.roll(c, 1, axis=0)).T)) == pytest.approx(sorted([s, s, t, t]), abs=1e-9)


def features(spark, found):
    rows = [(i, ve.POLYGON, [0] if len(p) else [], [tuple(map(float, q)) for q in p]) for i, p in enumerate(found)]
    return spark.createDataFrame([*rows, (1000, ve.POLYGON, None, None)], f"fid long, shape_type int, parts array<int>, points {ve.POINTS}").repartition(3)


def test_operators_take_empty_and_null_features(spark):
    found = shapes(3)
    frame = features(spark, found)
    circles = {r["fid"]: r for r in ve.minimum_bounding_circle(frame).collect()}
    ends = {r["fid"]: r["points"] for r in ve.polygon_long_axis(frame).collect()}
    hulls = {r["fid"]: r["points"] for r in ve.minimum_convex_hull(frame).collect()}
    assert set(circles) == set(ends) == set(hulls) == {*range(len(found)), 1000}
    for i, p in [*enumerate(found), (1000, np.empty((0, 2)))]:
        x, y, r = ve.enclosing_circle(p.reshape(-1, 2))
        assert (circles[i]["x"], circles[i]["y"], circles[i]["radius"]) == (x, y, r)
        assert len(circles[i]["points"]) == 129 and circles[i]["points"][0] == circles[i]["points"][-1]
        assert all(math.hypot(q["x"] - x, q["y"] - y) == pytest.approx(r, abs=1e-9) for q in circles[i]["points"])
        assert [tuple(q) for q in hulls[i]] == [(q["x"], q["y"]) for q in ve._closed(ve.convex_hull(p.reshape(-1, 2)))]
        assert ends[i] == sorted(ends[i]) and math.dist(*ends[i]) == pytest.approx(ve.minimum_box(p.reshape(-1, 2))[2], abs=1e-9)


def test_many_features_are_joined_to_one(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        parts = [[(rng.random(), rng.random()) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(0, 3))]
        rows.append((i * 7 % 300, ve.POLYGON, [sum(map(len, parts[:k])) for k in range(len(parts))], [q for p in parts for q in p], rng.choice("ab") if i else None))
    joined = ve.singlepart_to_multipart(spark.createDataFrame(rows, f"fid long, shape_type int, parts array<int>, points {ve.POINTS}, kind string").repartition(3), "kind")
    got = {r["kind"]: r for r in joined.collect()}
    for kind in ("a", "b", None):
        parts, points = [], []
        own = sorted(r for r in rows if r[4] == kind)
        for r in own:
            parts += [len(points) + at for at in r[2]]
            points += r[3]
        assert (got[kind]["fid"], got[kind]["parts"], [tuple(q) for q in got[kind]["points"]]) == (own[0][0], parts, points)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # of all parts before each part
