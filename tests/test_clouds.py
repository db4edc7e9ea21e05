"""Point clouds with many points at one place, few neighbours or far ground, against brute force."""

import math
import random
from statistics import mean, median

import pytest

from terracell.operators import lidar as li

COLUMNS = "pid long, x double, y double, z double, class int, ret int, n_ret int"


def points(seed=1, n=90, places=12):
    rng = random.Random(seed)
    at = [(rng.randrange(12) * 0.5, rng.randrange(12) * 0.5) for _ in range(places)] + [(40.0, -7.5), (90.5, 3.0)]
    return [(i, *rng.choice(at), round(rng.uniform(0, 60), 2), rng.choice((1, 1, 2, 3, 7, 18)), rng.choice((1, 2)), 2) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def away(a, b):
    return math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def opened(rows, r):
    low = {p[0]: min(q[3] for q in rows if away(p, q) <= r) for p in rows}
    return {p[0]: max(low[q[0]] for q in rows if away(p, q) <= r) for p in rows}


def most_join_rows(spark, run):
    """The most rows that a join of ``run`` makes."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    first = runs.apply(runs.size() - 1).executionId() + 1 if runs.size() else 0
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for i in range(runs.size()):
        if (number := runs.apply(i).executionId()) < first:
            continue
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for k in range(nodes.size()):
            metrics = nodes.apply(k).metrics() if "Join" in nodes.apply(k).name() else None
            for j in range(metrics.size() if metrics else 0):
                value = values.get(metrics.apply(j).accumulatorId()) if metrics.apply(j).name() == "number of output rows" else None
                most = max(most, int(value.get().replace(",", "")) if value is not None and value.isDefined() else 0)
    return most


@pytest.mark.parametrize("tool", ["tophat", "outliers", "medians", "height", "ground", "normals", "shade", "kappa"])
def test_points_of_one_place_do_not_meet_pair_by_pair(spark, tool):
    rows = [(i, i % 4 * 0.5, 0.0, float(i % 997), 1 + i % 2, 1, 1) for i in range(2000)]
    cloud = frame(spark, rows)
    how = {
        "tophat": lambda: li.lidar_tophat_transform(cloud, 1.0),
        "outliers": lambda: li.lidar_remove_outliers(cloud, 1.0),
        "medians": lambda: li.lidar_remove_outliers(cloud, 1.0, use_median=True),
        "height": lambda: li.height_above_ground(cloud),
        "ground": lambda: li.lidar_ground_point_filter(cloud, 1.0, 2),
        "normals": lambda: li.normal_vectors(cloud, 1.0),
        "shade": lambda: li.lidar_hillshade(cloud),
        "kappa": lambda: li.lidar_kappa_index(cloud, cloud, 0.1),
    }[tool]
    assert 0 < most_join_rows(spark, lambda: how().collect()) <= 5 * len(rows)  # a place and the levels of four places


def test_tophat(spark):
    rows = points(2)
    base = opened(rows, 1.0)
    got = {r["pid"]: r["z"] for r in li.lidar_tophat_transform(frame(spark, rows), 1.0).collect()}
    assert got == pytest.approx({p[0]: p[3] - base[p[0]] for p in rows})


@pytest.mark.parametrize("middle", [mean, median])
def test_outliers(spark, middle):
    rows = points(3)
    live = [p for p in rows if p[4] not in (7, 18)]
    want = {}
    for p in rows:
        others = [q[3] for q in live if q[0] != p[0] and away(p, q) <= 1.0] if p in live else []
        d = p[3] - middle(others) if others else 0
        want[p[0]] = 18 if d >= 15 else 7 if d <= -15 else p[4]
    cloud = frame(spark, rows)
    got = {r["pid"]: r["class"] for r in li.lidar_remove_outliers(cloud, 1.0, 15.0, middle is median).collect()}
    assert got == want and len(set(want.values()) & {7, 18}) == 2
    kept = {r["pid"] for r in li.lidar_remove_outliers(cloud, 1.0, 15.0, middle is median, False).collect()}
    assert kept == {p[0] for p in rows if want[p[0]] == p[4] or (p[4] in (7, 18))}


def test_height_above_ground_at_any_distance(spark):
    rows = [p if p[1] < 20 or p[4] != 2 else (*p[:4], 3, *p[5:]) for p in points(4)]
    ground = [p for p in rows if p[4] == 2]
    want = {p[0]: 0.0 if p[4] == 2 else p[3] - min(ground, key=lambda q: (away(p, q), q[0]))[3] for p in rows}
    assert max(min(away(p, q) for q in ground) for p in rows) > 50
    got = {r["pid"]: r["z"] for r in li.height_above_ground(frame(spark, rows)).collect()}
    assert got == pytest.approx(want)
    none = li.height_above_ground(frame(spark, [p for p in rows if p[4] != 2])).collect()
    assert none and all(r["z"] is None for r in none)


@pytest.mark.parametrize("norm", [True, False])
@pytest.mark.parametrize("least", [0, 9, 1000])
def test_ground_filter_extends_neighbourhoods_and_flattens_slopes(spark, norm, least):
    rows = points(5)
    quiet = [p for p in rows if p[4] not in (7, 18)]
    last = [p for p in quiet if p[5] == p[6]]
    base = opened(last, 1.0) if norm else dict.fromkeys([p[0] for p in last], 0.0)
    want = {}
    for p in quiet:
        off = p not in last
        if not off:
            reach = max([1.0, *sorted(away(p, q) for q in last)[:least][-1:]])
            own = p[3] - base[p[0]]
            rises = [(own - (q[3] - base[q[0]]), away(p, q)) for q in last if 0 < away(p, q) <= reach]
            off = norm and own >= 2 or any(d > s * math.tan(math.radians(60)) and (norm or d > 2) for d, s in rises)
        want[p[0]] = 1 if off else 2
    got = {r["pid"]: r["class"] for r in li.lidar_ground_point_filter(frame(spark, rows), 1.0, least, 60.0, 2.0, slope_norm=norm).collect()}
    assert got == want and set(want.values()) == {1, 2}


@pytest.mark.parametrize("radius", [0.001, 1.0])
def test_kappa_meets_the_nearest_in_space(spark, radius):
    rows, others = points(6), points(7, 60)
    others = [(q[0], *rows[q[0]][1:3], rows[q[0]][3] if q[0] % 3 else q[3], *q[4:]) for q in others]
    want = {}
    for p in rows:
        near = [((away(p, q) ** 2 + (p[3] - q[3]) ** 2, q[0]), q[4]) for q in others if away(p, q) <= radius]
        if near:
            pair = (p[4], min(near)[1])
            want[pair] = want.get(pair, 0) + 1
    got = li.lidar_kappa_index(frame(spark, rows), frame(spark, others), radius).collect()
    assert {(r["class1"], r["class2"]): r["n"] for r in got} == want


def test_subset_rounds_doubles_as_they_are(spark):
    """A thousand times 2.0035 is below 2003.5, so it rounds down; halves that are exact go away from zero."""
    rows = [(1, 0.0, 0.0, 2.0035, 1, 1, 1), (2, 0.0, 0.0, 2.004, 1, 1, 1), (3, 0.0, 0.0, 2.003, 1, 1, 1), (4, 0.0, 0.0, -0.0625, 1, 1, 1), (5, 0.0, 0.0, -0.063, 1, 1, 1)]
    assert 2.0035 * 1000 < 2003.5 and -0.0625 * 1000 == -62.5
    cloud = frame(spark, rows)
    got = {r["pid"]: r["class"] for r in li.lidar_classify_subset(cloud, cloud.where("pid in (1, 4)"), 9, 1).collect()}
    assert got == {1: 9, 2: 1, 3: 9, 4: 9, 5: 9}
