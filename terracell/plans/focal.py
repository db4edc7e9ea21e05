"""Neighbourhood plans: offset joins, range-frame windows and tiles with halos.

``neighbours`` joins cells with fixed offsets.  ``boxes`` builds separable sums, counts and extrema from two
range-frame windows.  ``tiled`` gives NumPy kernels a dense block with a halo: each cell goes to the
tiles whose block or halo holds it, so a tile's work and memory have a fixed bound at any raster size.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import ship

KEY = ["row", "col"]
TILE = 128
EIGHT = [(-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0)]  # (row, col) steps, clockwise from the north-east


def neighbours(cells: DataFrame, offsets: Iterable[tuple[int, int]] = EIGHT) -> DataFrame:
    """row, col, value, k, other: every cell with the value at each offset (numbered from 0) that is on the grid."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(offsets)])
    # a cell is sent to those that it is a neighbour of
    sent = cells.select("row", "col", F.col("value").alias("other"), F.explode(steps).alias("s"))
    sent = sent.select((F.col("row") - F.col("s.dr")).alias("row"), (F.col("col") - F.col("s.dc")).alias("col"), F.col("s.k").alias("k"), "other")
    return cells.select(*KEY, "value").join(sent, KEY)


def boxes(cells: DataFrame, half: int | tuple[int, int], how: dict[str, tuple[Callable[[Column], Column], Column]]) -> DataFrame:
    """Separable window aggregates: ``how`` gives a name its function (sum, min, max) and its input expression.

    Frames are ranges on the index, so missing cells keep their place; edges clip the window.
    """
    hr, hc = (half, half) if isinstance(half, int) else half
    by_row = W.partitionBy("row").orderBy("col").rangeBetween(-hc, hc)
    by_col = W.partitionBy("col").orderBy("row").rangeBetween(-hr, hr)
    first = cells.select(*KEY, "value", *[e.alias(n) for n, (_, e) in how.items()])
    first = first.select(*KEY, "value", *[f(F.col(n)).over(by_row).alias(n) for n, (f, _) in how.items()])
    return first.select(*KEY, "value", *[f(F.col(n)).over(by_col).alias(n) for n, (f, _) in how.items()])


def tiled(layers: list[DataFrame], halo: int, kernel: Callable[..., np.ndarray | list[np.ndarray]], names: tuple[str, ...] = ("value",), tile: int = TILE) -> DataFrame:
    """``kernel`` applied to aligned rasters in tiles with a halo.

    It gets one float array a layer, NaN for NoData, missing cells and what is off the grid, and returns
    arrays of the same shape, of which the tile's own part is kept; NaN becomes null.  Every cell of
    the first layer has a row in the result.
    """
    joined = layers[0].select(*KEY, F.col("value").alias("v0"))
    for i, other in enumerate(layers[1:], 1):
        joined = joined.join(other.select(*KEY, F.col("value").alias(f"v{i}")), KEY, "left")
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    sent = joined.withColumn("tr", F.explode(reach("row"))).withColumn("tc", F.explode(reach("col")))
    n, size = len(layers), tile + 2 * halo

    def run(key, table):
        import pyarrow as pa

        tr, tc = (k.as_py() for k in key)
        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        r, c = row - tr * tile + halo, col - tc * tile + halo
        grids = []
        for i in range(n):
            g = np.full((size, size), np.nan)
            g[r, c] = table.column(f"v{i}").to_numpy(zero_copy_only=False).astype(float)
            grids.append(g)
        here = np.zeros((size, size), bool)
        here[r, c] = True
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # windows without data
            out = kernel(*grids)
        out = out if isinstance(out, list) else [out]
        inner = np.zeros((size, size), bool)
        inner[halo : halo + tile, halo : halo + tile] = True
        at = np.nonzero(here & inner)
        columns = {"row": pa.array((at[0] + tr * tile - halo).astype(np.int32)), "col": pa.array((at[1] + tc * tile - halo).astype(np.int32))}
        for name, g in zip(names, out, strict=True):
            v = g[at].astype(float)
            columns[name] = pa.array(v, mask=np.isnan(v))
        return pa.table(columns)

    ship(sent.sparkSession)
    schema = "row int, col int, " + ", ".join(f"{x} double" for x in names)
    return sent.groupBy("tr", "tc").applyInArrow(run, schema)


def shifted(grid: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The value at (row + dr, col + dc) of every cell; NaN beyond the block."""
    out = np.full_like(grid, np.nan)
    h, w = grid.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = grid[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def window(grid: np.ndarray, half: int | tuple[int, int]) -> np.ndarray:
    """All shifts of a block within a window, stacked; the centre is the middle one."""
    hr, hc = (half, half) if isinstance(half, int) else half
    return np.stack([shifted(grid, r, c) for r in range(-hr, hr + 1) for c in range(-hc, hc + 1)])
