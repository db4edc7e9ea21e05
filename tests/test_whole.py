"""Queries that no SQL covers work on their whole tables."""

import math

import numpy as np
import pytest

from terracell.queries import QUERIES


def cloud(rows):
    """pid -> (x, y, z) as the queries' points are made of lineitem rows."""
    return {o * 8 + n: (p % 197 * 0.5, o % 211 * 0.5, price / 1000) for o, n, p, price in rows}


@pytest.mark.parametrize("name", ["normal_vectors", "lidar_hillshade"])
def test_every_point_of_the_cloud_is_used(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    rows = [(o, n, int(p), float(z)) for o in [*range(1, 40), *range(422_000, 422_040)] for n, p, z in zip((1, 3, 7), rng.integers(0, 8, 3), rng.uniform(900, 90_000, 3).round(2), strict=True)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_returnflag string"
    spark.createDataFrame([(o, n, p, 1, z, 25.0, "A") for o, n, p, z in rows], columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["pid"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    points = cloud(rows)
    assert set(got) == set(points)
    compared = 0
    for pid, (x, y, _) in points.items():
        near = np.array([q for q in points.values() if math.hypot(q[0] - x, q[1] - y) <= 1.0])
        own = near - near.mean(axis=0)
        if np.linalg.matrix_rank(own[:, :2], tol=1e-6) < 2:
            continue
        p, q = np.linalg.lstsq(own[:, :2], own[:, 2], rcond=None)[0]
        normal = np.array([-p, -q, 1]) / math.sqrt(p * p + q * q + 1)
        compared += 1
        if name == "normal_vectors":
            assert [got[pid][c] for c in ("red", "green", "blue")] == pytest.approx(list((normal + 1) / 2 * 255), abs=1.01)
        else:
            az, alt = math.radians(315), math.radians(30)
            light = (math.sin(az) * math.cos(alt), math.cos(az) * math.cos(alt), math.sin(alt))
            assert got[pid]["shade"] == pytest.approx(max(normal @ light, 0) * 255, abs=1.01)
    assert compared > 100
