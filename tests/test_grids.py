"""Tiny rasters with answers worked out by hand, and graph operators against plain loops."""

import random

import numpy as np
import pytest

from terracell.operators import cellmath as cm
from terracell.operators import hydrology as hy
from terracell.registry import TOOLS, describe, list_tools, run_tool

SCHEMA = "row int, col int, value double"


def raster(spark, grid):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)], SCHEMA)


def values(df, column="value"):
    return {(r["row"], r["col"]): r[column] for r in df.collect()}


def test_nodata_rules(spark):
    a, b = raster(spark, [[1.0]]), raster(spark, [[None]])
    one = lambda df: df.first()["value"]
    assert one(run_tool("SumOverlay", [a, b])) == 1 and one(run_tool("average overlay", [a, b])) == 1
    assert one(cm.weighted_sum([a, b], [1, 1])) is None
    assert one(cm.count_if([raster(spark, [[1]]), raster(spark, [[3]])], 2.0)) is None
    assert one(run_tool("HighestPosition", [raster(spark, [[x]]) for x in (5, 9, 9)])) == 2
    zero = raster(spark, [[0.0]])
    assert one(cm.unary("Ln", zero)) is None and one(cm.unary("Log2", zero)) is None
    assert one(cm.binary("Divide", raster(spark, [[4.0]]), 0.0)) is None


def test_d8_pointer(spark):
    got = values(hy.d8_pointer(raster(spark, [[6, 6, 6], [6, 5, 4], [6, 6, 6]])))
    assert got[1, 1] == 2 and got[1, 2] == 0


def random_dem(seed, rows=23, cols=17):
    rng = random.Random(seed)
    return [[None if rng.random() < 0.05 else rng.randint(0, 400) / 8 for _ in range(cols)] for _ in range(rows)]


def downhill(grid):
    out = {}
    at = {(r, c): v for r, line in enumerate(grid) for c, v in enumerate(line) if v is not None}
    for (r, c), v in at.items():
        best, to = 0.0, None
        for dr, dc in hy.EIGHT:
            if (r + dr, c + dc) in at:
                drop = (v - at[r + dr, c + dc]) / (2**0.5 if dr and dc else 1.0)
                if drop > best:
                    best, to = drop, (r + dr, c + dc)
        out[r, c] = to
    return at, out


@pytest.mark.parametrize("seed", [0, 1])
def test_accumulation_and_basins(spark, seed):
    grid = random_dem(seed)
    _, to = downhill(grid)
    acc, end = dict.fromkeys(to, 0), {}
    for start in to:
        now = start
        while now is not None:
            acc[now] += 1
            end[start] = now
            now = to[now]
    pointer = hy.d8_pointer(raster(spark, grid))
    assert values(hy.d8_flow_accumulation(pointer)) == {k: float(v) for k, v in acc.items()}
    assert values(hy.basins(pointer)) == {k: r * 1_000_000.0 + c for k, (r, c) in end.items()}


def flooded(grid):
    """Priority flood from the edges and NoData."""
    import heapq

    at, _ = downhill(grid)
    heap, done = [], {}
    for r, c in at:
        if any((r + dr, c + dc) not in at for dr, dc in hy.EIGHT):
            heapq.heappush(heap, (at[r, c], (r, c)))
    while heap:
        z, (r, c) = heapq.heappop(heap)
        if (r, c) in done:
            continue
        done[r, c] = z
        for dr, dc in hy.EIGHT:
            k = (r + dr, c + dc)
            if k in at and k not in done:
                heapq.heappush(heap, (max(z, at[k]), k))
    return done


@pytest.mark.parametrize("tile", [128, 8])
def test_fill_equals_priority_flood(spark, tile):
    grid = random_dem(3)
    want = flooded(grid)
    got = values(hy.fill_depressions(raster(spark, grid), tile=tile))
    assert {k: v for k, v in got.items() if v is not None} == want


def test_strahler_order(spark):
    """Two heads meet to order 2; a third of order 1 leaves it; two of order 2 make 3."""
    grid = [[9, None, 9, None, 9, None, 9], [None, 7, None, None, None, 7, None], [None, None, 6, None, 6, None, None], [None, None, None, 3, None, None, None], [None, None, None, 2, None, None, None]]
    dem = raster(spark, grid)
    order = values(hy.strahler_stream_order(hy.d8_pointer(dem), dem.selectExpr("row", "col", "if(value is null, null, 1.0D) as value")))
    assert order[0, 0] == 1 and order[1, 1] == 2 and order[2, 2] == 2 and order[3, 3] == 3 and order[4, 3] == 3


def test_clump_equals_flood_fill(spark):
    rng = random.Random(5)
    grid = [[rng.choice([1, 1, 2, None]) for _ in range(14)] for _ in range(19)]
    at, _ = downhill(grid)
    for diag in (False, True):
        steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diag
        label, n = {}, 0
        for k in sorted(at):
            if k not in label:
                n += 1
                todo = [k]
                while todo:
                    x = todo.pop()
                    if x not in label:
                        label[x] = float(n)
                        todo += [y for y in ((x[0] + a, x[1] + b) for a, b in steps) if at.get(y) == at[x]]
        assert values(hy.clump(raster(spark, grid), diag=diag)) == label


def test_distance_and_allocation(spark):
    rng = random.Random(2)
    grid = [[float(rng.random() < 0.04) for _ in range(20)] for _ in range(20)]
    targets = [(r, c) for r in range(20) for c in range(20) if grid[r][c]]
    got = values(hy.euclidean_distance(raster(spark, grid)))
    for (r, c), d in got.items():
        assert d == pytest.approx(min(np.hypot(r - a, c - b) for a, b in targets))


def test_register(spark):
    assert len(TOOLS) > 340 and "D8Pointer" in list_tools("d8")
    rows = describe(spark).collect()
    assert len(rows) == len(TOOLS) and all(r["summary"] for r in rows)
    with pytest.raises(KeyError):
        run_tool("no such tool")


@pytest.mark.parametrize("seed", [0, 4])
def test_horton_and_hack_orders(spark, seed):
    """Against walks over the tree of stream cells; branches of equal length are told apart by their cells."""
    grid = random_dem(seed)
    at, to = downhill(grid)
    cells = {c for c in at if any(v == c for v in to.values())}
    into = {c: [u for u in cells if to[u] == c] for c in cells}
    step = lambda u: 2**0.5 if u[0] != to[u][0] and u[1] != to[u][1] else 1.0

    def far(c):
        return max((far(u) + step(u) for u in into[c]), default=0.0)

    def strahler(c):
        orders = sorted((strahler(u) for u in into[c]), reverse=True)
        return (orders[0] + (len(orders) > 1 and orders[0] == orders[1])) if orders else 1

    horton, hack = {}, {}

    def walk(c, mouth, order):
        horton[c], hack[c] = strahler(mouth), order
        kids = sorted(into[c], key=lambda u: (-round(far(u) + step(u), 6), u))
        for k, u in enumerate(kids):
            walk(u, mouth if k == 0 else u, order if k == 0 else order + 1)

    for c in cells:
        if to[c] is None:
            walk(c, c, 1)
    pointer, streams = hy.d8_pointer(raster(spark, grid)), spark.createDataFrame([(r, c, 1.0) for r, c in cells], SCHEMA)
    assert values(hy.horton_stream_order(pointer, streams)) == horton
    assert values(hy.hack_stream_order(pointer, streams)) == hack
    assert values(hy.find_main_stem(pointer, streams)) == {c: 1.0 if o == 1 else None for c, o in hack.items()}
