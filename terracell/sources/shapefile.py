"""Shapefiles with their attribute tables.

Features come as file, fid (the record's number), shape_type, parts, points, z, m and attributes, a map of texts;
z and m are null where a shape has none.  A null shape has type 0 and no points.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from .files import written

FEATURES = "file string, fid long, shape_type int, parts array<int>, points array<struct<x:double,y:double>>, z array<double>, m array<double>, attributes map<string,string>"
_MULTI, _PARTS = (8, 18, 28), (3, 5, 13, 15, 23, 25)


def shapes(content: bytes) -> Iterator[tuple[int, int, list[int], np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(record's number, type, parts, points, z, m) of each record."""
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">ii", content, at)
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack_from("<i", body)[0]
        parts, points, place = [0], np.empty((0, 2)), 4
        if kind % 10 == 1:
            points, place = np.frombuffer(body, "<f8", 2, 4).reshape(1, 2), 20
        elif kind in _MULTI:
            n = struct.unpack_from("<i", body, 36)[0]
            points, place = np.frombuffer(body, "<f8", 2 * n, 40).reshape(n, 2), 40 + 16 * n
        elif kind in _PARTS:
            k, n = struct.unpack_from("<ii", body, 36)
            parts = list(struct.unpack_from(f"<{k}i", body, 44))
            points, place = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * k).reshape(n, 2), 44 + 4 * k + 16 * n
        elif kind:
            raise ValueError(f"shapes of type {kind} aren't read")
        n, bounds = len(points), 0 if kind % 10 == 1 else 16
        z = m = None
        if 10 < kind < 20:
            z, place = np.frombuffer(body, "<f8", n, place + bounds), place + bounds + 8 * n
        if kind > 10 and place + bounds + 8 * n <= len(body):
            m = np.frombuffer(body, "<f8", n, place + bounds)
        yield number, kind, parts if kind else [], points, z, m


def attributes(content: bytes) -> list[dict[str, str | None]]:
    """The rows of a DBF table; blank values are null, and of deleted rows too."""
    n, head, size = struct.unpack_from("<iHH", content, 4)
    columns, at, place = [], 32, 1
    while content[at] != 13:
        length = content[at + 16]
        columns.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), place, length))
        place, at = place + length, at + 32
    rows = []
    for k in range(n):
        row = content[head + k * size : head + (k + 1) * size]
        rows.append({name: (row[a : a + length].decode("utf-8", "replace").strip(" \0") or None) if row[:1] != b"*" else None for name, a, length in columns})
    return rows


def _features(table: pa.Table) -> pa.Table:
    by = {e.as_py(): c.as_py() for e, c in zip(table.column("ext"), table.column("content"), strict=True)}
    name = table.column("base")[0].as_py().rsplit("/", 1)[-1]
    rows = attributes(by["dbf"]) if "dbf" in by else []
    out = []
    for i, (fid, kind, parts, points, z, m) in enumerate(shapes(by["shp"]) if "shp" in by else ()):
        own = list((rows[i] if i < len(rows) else {}).items())
        out.append({"file": name, "fid": fid, "shape_type": kind, "parts": parts, "points": [{"x": x, "y": y} for x, y in points.tolist()], "z": None if z is None else z.tolist(), "m": None if m is None else m.tolist(), "attributes": own})
    return pa.Table.from_pylist(out, schema=_SCHEMA)


_SCHEMA = pa.schema([
    ("file", pa.string()), ("fid", pa.int64()), ("shape_type", pa.int32()), ("parts", pa.list_(pa.int32())), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))),
    ("z", pa.list_(pa.float64())), ("m", pa.list_(pa.float64())), ("attributes", pa.map_(pa.string(), pa.string())),
])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The features of every Shapefile below the path; a file and its table are read by one task."""
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("base"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("ext"), "content")
    return named.groupBy("base").applyInArrow(_features, FEATURES)


def _record(kind: int, parts: list[int], points: list[dict]) -> bytes:
    own = np.array([(p["x"], p["y"]) for p in points], "<f8").reshape(-1, 2)
    if not len(own):
        return struct.pack("<i", 0)
    if kind == 1:
        return struct.pack("<i", 1) + own[:1].tobytes()
    head = struct.pack("<i4d", kind, *own.min(axis=0), *own.max(axis=0))
    if kind == 8:
        return head + struct.pack("<i", len(own)) + own.tobytes()
    return head + struct.pack(f"<ii{len(parts)}i", len(parts), len(own), *parts) + own.tobytes()


def _shp(kind: int, records: list[bytes], box: tuple) -> tuple[bytes, bytes]:
    def head(words: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, kind, *box, 0, 0, 0, 0)

    body, index, at = [], [], 50
    for k, r in enumerate(records, 1):
        body.append(struct.pack(">ii", k, len(r) // 2) + r)
        index.append(struct.pack(">ii", at, len(r) // 2))
        at += 4 + len(r) // 2
    return head(at) + b"".join(body), head(50 + 4 * len(records)) + b"".join(index)


def _field(name: str, kind: pa.DataType) -> tuple[str, str, int, int]:
    if pa.types.is_boolean(kind):
        return name, "L", 1, 0
    if pa.types.is_integer(kind):
        return name, "N", 20, 0
    if pa.types.is_floating(kind) or pa.types.is_decimal(kind):
        return name, "N", 24, 15
    if pa.types.is_date(kind):
        return name, "D", 8, 0
    return name, "C", 254, 0


def _value(v, kind: str, length: int) -> bytes:
    if v is None:
        return b" " * length
    if kind == "L":
        return b"T" if v else b"F"
    text = v.strftime("%Y%m%d") if kind == "D" else repr(float(v)) if kind == "N" and not isinstance(v, int) else str(v)
    raw = text.encode("utf-8")[:length]
    return raw.rjust(length) if kind == "N" else raw.ljust(length)


def _dbf(table: pa.Table, names: list[str]) -> bytes:
    columns = [_field(n, table.schema.field(n).type) for n in names] or [("FID", "N", 20, 0)]
    values = [table.column(n).to_pylist() for n in names] or [list(range(1, table.num_rows + 1))]
    size = 1 + sum(c[2] for c in columns)
    day = datetime.date(2000, 1, 1)
    head = struct.pack("<BBBBiHH20x", 3, day.year - 1900, day.month, day.day, table.num_rows, 33 + 32 * len(columns), size)
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], k.encode(), length, places) for n, k, length, places in columns) + b"\r"
    rows = [b" " + b"".join(_value(v, c[1], c[2]) for v, c in zip(row, columns, strict=True)) for row in zip(*values, strict=True)]
    return head + b"".join(rows) + b"\x1a"


def write(features: DataFrame, path: str, per_file: int = 100_000) -> int:
    """Points, multipoints, lines or polygons with their other columns as attributes, in files of ``per_file``
    consecutive fids and one shape type; their number.  Names are cut to ten bytes and texts to 254, as the format says."""
    names = [c for c, t in features.dtypes if c not in ("file", "fid", "shape_type", "parts", "points", "z", "m") and not t.startswith(("array", "map", "struct"))]

    def run(table: pa.Table) -> dict[str, bytes]:
        table = table.sort_by("fid")
        kind, k = table.column("shape_type")[0].as_py(), table.column("block")[0].as_py()
        records = [_record(kind, parts, points or []) for parts, points in zip(table.column("parts").to_pylist(), table.column("points").to_pylist(), strict=True)]
        every = np.array([(p["x"], p["y"]) for points in table.column("points").to_pylist() for p in points or ()], float).reshape(-1, 2)
        box = (*every.min(axis=0), *every.max(axis=0)) if len(every) else (0.0,) * 4
        shp, shx = _shp(kind, records, box)
        return {f"{kind}_{k}.{e}": c for e, c in (("shx", shx), ("dbf", _dbf(table, ["fid", *names])), ("shp", shp))}

    return written(features.select("fid", "shape_type", "parts", "points", *names, F.floor(F.col("fid") / per_file).cast("long").alias("block")), ["shape_type", "block"], path, run) // 3
