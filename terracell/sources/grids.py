"""ASCII rasters: Arc ASCII, GRASS ASCII and Surfer ASCII.

Cells come as file, row, col, value, rows from the north, null where the file has its NoData; ``headers`` has
a file's extent.  A row or column that a file lacks is an error of that file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import ROWS, parsed, tiles, written

CELLS = "file string, row int, col int, value double"
HEADER = "file string, rows int, columns int, north double, south double, east double, west double, nodata double"
NODATA = -32768.0
KINDS = {"arc": "asc", "grass": "txt", "surfer": "grd"}


class Grid:
    """rows, columns, edges, nodata and the values, a row a row from the north."""

    def __init__(self, values: np.ndarray, north: float, south: float, east: float, west: float, nodata: float | None):
        self.values, self.north, self.south, self.east, self.west, self.nodata = values, north, south, east, west, nodata

    def header(self, name: str) -> dict[str, list]:
        rows, columns = self.values.shape
        return {"file": [name], "rows": [rows], "columns": [columns], "north": [self.north], "south": [self.south], "east": [self.east], "west": [self.west], "nodata": [self.nodata]}

    def cells(self, name: str) -> Iterator[dict[str, object]]:
        rows, columns = self.values.shape
        step = max(1, ROWS // max(columns, 1))
        for at in range(0, rows, step):
            own = self.values[at : at + step]
            row, col = np.indices(own.shape, dtype=np.int32)
            value = pa.array(own.ravel(), pa.float64(), mask=np.isnan(own.ravel()) | (own.ravel() == self.nodata if self.nodata is not None else False))
            yield {"file": [name] * own.size, "row": (row + at).ravel(), "col": col.ravel(), "value": value}


def _shaped(words: list[bytes], rows: int, columns: int, name: str) -> np.ndarray:
    if len(words) != rows * columns:
        raise ValueError(f"{name} has {len(words)} values, not {rows} x {columns}")
    return np.array([np.nan if w == b"*" else float(w) for w in words], float).reshape(rows, columns)


def parse_arc(name: str, content: bytes) -> Grid:
    lines = content.split(b"\n")
    head: dict[str, float] = {}
    at = 0
    while at < len(lines) and (w := lines[at].split()) and w[0][:1].isalpha() and len(w) == 2:
        head[w[0].decode().lower()] = float(w[1])
        at += 1
    rows, columns, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    west = head["xllcorner"] if "xllcorner" in head else head["xllcenter"] - size / 2
    south = head["yllcorner"] if "yllcorner" in head else head["yllcenter"] - size / 2
    return Grid(_shaped(b" ".join(lines[at:]).split(), rows, columns, name), south + rows * size, south, west + columns * size, west, head.get("nodata_value", -9999.0))


def parse_grass(name: str, content: bytes) -> Grid:
    lines = content.split(b"\n")
    head: dict[str, str] = {}
    at = 0
    while at < len(lines) and b":" in lines[at]:
        key, _, value = lines[at].decode().partition(":")
        head[key.strip().lower()] = value.strip()
        at += 1
    null = head.get("null", "*")
    values = _shaped([b"*" if w.decode() == null else w for w in b" ".join(lines[at:]).split()], int(head["rows"]), int(head["cols"]), name)
    return Grid(values, *(float(head[k]) for k in ("north", "south", "east", "west")), None)


def parse_surfer(name: str, content: bytes) -> Grid:
    words = content.split()
    if words[0] != b"DSAA":
        raise ValueError(f"{name} is no Surfer ASCII grid")
    columns, rows = int(words[1]), int(words[2])
    x0, x1, y0, y1 = map(float, words[3:7])  # of the outer cells' centres; rows go from the south
    dx, dy = (x1 - x0) / max(columns - 1, 1) / 2, (y1 - y0) / max(rows - 1, 1) / 2
    return Grid(_shaped(words[9:], rows, columns, name)[::-1], y1 + dy, y0 - dy, x1 + dx, x0 - dx, 1.70141e38)


PARSERS = {"arc": parse_arc, "grass": parse_grass, "surfer": parse_surfer}


def _text(values: np.ndarray, null: str) -> str:
    return "\n".join(" ".join(null if np.isnan(v) else repr(float(v)) for v in row) for row in values) + "\n"


def encode(kind: str, values: np.ndarray, north: float, west: float, size: float) -> bytes:
    """A file of the values, NaN for NoData."""
    rows, columns = values.shape
    south, east = north - rows * size, west + columns * size
    if kind == "arc":
        head = f"ncols {columns}\nnrows {rows}\nxllcorner {west!r}\nyllcorner {south!r}\ncellsize {size!r}\nNODATA_value {NODATA}\n"
        return (head + _text(values, str(NODATA))).encode()
    if kind == "grass":
        return (f"north: {north!r}\nsouth: {south!r}\neast: {east!r}\nwest: {west!r}\nrows: {rows}\ncols: {columns}\nnull: *\n" + _text(values, "*")).encode()
    known = values[~np.isnan(values)]
    low, high = (float(known.min()), float(known.max())) if known.size else (0.0, 0.0)
    half = size / 2
    return (f"DSAA\n{columns} {rows}\n{west + half!r} {east - half!r}\n{south + half!r} {north - half!r}\n{low!r} {high!r}\n" + _text(values[::-1], "1.70141e+38")).encode()


def block(table: pa.Table) -> tuple[np.ndarray, int, int]:
    """The values of a tile's cells as an array, NaN where none is, and its first row and column."""
    row, col = (table.column(c).to_numpy() for c in ("row", "col"))
    value = table.column("value").to_numpy(zero_copy_only=False).astype(float)
    r0, c0 = int(row.min()), int(col.min())
    values = np.full((int(row.max()) - r0 + 1, int(col.max()) - c0 + 1), np.nan)
    values[row - r0, col - c0] = value
    return values, r0, c0


def read(spark: SparkSession, path: str, kind: str = "arc") -> DataFrame:
    """file, row, col, value of every file of the kind below the path."""
    return parsed(spark, path, f"*.{KINDS[kind]}", lambda n, c: PARSERS[kind](n, c).cells(n), CELLS)


def headers(spark: SparkSession, path: str, kind: str = "arc") -> DataFrame:
    return parsed(spark, path, f"*.{KINDS[kind]}", lambda n, c: iter([PARSERS[kind](n, c).header(n)]), HEADER)


def write(cells: DataFrame, path: str, kind: str = "arc", north: float = 0.0, west: float = 0.0, size: float = 1.0, tile: int = 1024) -> int:
    """Tiles of at most ``tile`` rows and columns, named by their first row and column; the number of files."""

    def run(table: pa.Table) -> dict[str, bytes]:
        values, r0, c0 = block(table)
        return {f"{r0}_{c0}.{KINDS[kind]}": encode(kind, values, north - r0 * size, west + c0 * size, size)}

    return written(tiles(cells, tile), ["tr", "tc"], path, run)


def merged(cells: DataFrame, heads: DataFrame, north: float, west: float, size: float = 1.0) -> DataFrame:
    """The cells of all files on one grid, by the places that their headers name."""
    from pyspark.sql import functions as F

    at = heads.select("file", F.round((F.lit(north) - F.col("north")) / size).cast("int").alias("r0"), F.round((F.col("west") - west) / size).cast("int").alias("c0"))
    return cells.join(at, "file").select((F.col("row") + F.col("r0")).alias("row"), (F.col("col") + F.col("c0")).alias("col"), "value")
