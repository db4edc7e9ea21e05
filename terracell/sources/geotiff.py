"""GeoTIFF rasters: classic and big TIFF, strips or tiles, one band or several.

Reads signed, unsigned and floating samples that are stored plain or by Deflate, LZW or PackBits, with
horizontal or floating-point differences.  Writes doubles in deflated strips.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import parsed, tiles, written
from .grids import HEADER, Grid, block

CELLS = "file string, band int, row int, col int, value double"
#: Fixed values of the format: TIFF field types and their sizes in bytes.
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


def _lzw(data: bytes) -> bytes:
    out, table, width, bits, held, last = bytearray(), {}, 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = {}, 9, b""
            continue
        entry = bytes([code]) if code < 256 else table[code] if code in table else last + last[:1]
        out += entry
        if last:
            table[258 + len(table)] = last + entry[:1]
        last = entry
        width = min(12, max(9, (259 + len(table)).bit_length()))
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def fields(content: bytes) -> tuple[str, dict[int, tuple]]:
    """The byte order and the first directory's fields by tag."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    big = struct.unpack_from(order + "H", content, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), content, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), content, at)[0]
    at += 8 if big else 2
    out = {}
    for k in range(n):
        place = at + k * (20 if big else 12)
        tag, kind = struct.unpack_from(order + "HH", content, place)
        count = struct.unpack_from(order + ("Q" if big else "I"), content, place + 4)[0]
        if kind not in _TYPES:
            continue
        letters, size = _TYPES[kind]
        value = place + (12 if big else 8)
        if size * count > (8 if big else 4):
            value = struct.unpack_from(order + ("Q" if big else "I"), content, value)[0]
        got = struct.unpack_from(order + letters * count if len(letters) > 1 else f"{order}{count}{letters}", content, value)
        out[tag] = (b"".join(got).rstrip(b"\0").decode("latin-1"),) if kind == 2 else got
    return order, out


def bands(content: bytes) -> list[Grid]:
    """Each band of a file's first image."""
    order, tag = fields(content)
    get = lambda t, default=None: tag.get(t, (default,))[0]
    columns, rows, bits, samples = get(256), get(257), get(258, 1), get(277, 1)
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits aren't read")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[get(339, 1)]}{bits // 8}")
    tiled = 322 in tag
    width, height = (get(322), get(323)) if tiled else (columns, min(get(278, rows), rows))
    offsets, counts = tag[324 if tiled else 273], tag[325 if tiled else 279]
    planar, predictor, packing = get(284, 1) == 2, get(317, 1), get(259, 1)
    across = -(-columns // width)
    per = across * -(-rows // height)
    own = 1 if planar else samples
    out = np.zeros((samples, rows, columns))
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        data = content[offset : offset + count]
        data = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}[packing](data)
        r0, c0 = i % per // across * height, i % per % across * width
        h = height if tiled else min(height, rows - r0)
        if predictor == 3:
            raw = np.frombuffer(data, np.uint8, h * width * own * kind.itemsize).reshape(h, kind.itemsize, width * own)
            raw = np.cumsum(raw.reshape(h, -1, own), axis=1, dtype=np.uint8).reshape(h, kind.itemsize, width * own)
            part = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(h, width, own)
        else:
            part = np.frombuffer(data, kind, h * width * own).reshape(h, width, own)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        part = part[: rows - r0, : columns - c0]
        for b in range(own):
            out[i // per if planar else b, r0 : r0 + part.shape[0], c0 : c0 + part.shape[1]] = part[:, :, b]
    dx, dy = tag.get(33550, (1.0, 1.0))[:2]
    i, j, _, x, y = tag.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0))[:5]
    half = 0.5 if 34735 in tag and any(tag[34735][k] == 1025 and tag[34735][k + 3] == 2 for k in range(4, len(tag[34735]), 4)) else 0.0  # points, not areas
    west, north = x - (i + half) * dx, y + (j + half) * dy
    nodata = float(get(42113)) if 42113 in tag else None
    return [Grid(b, north, north - rows * dy, west + columns * dx, west, nodata) for b in out]


def encode(values: np.ndarray, north: float, west: float, size: float, nodata: float = -32768.0) -> bytes:
    """A little-endian file of doubles, deflated in strips of 64 rows."""
    rows, columns = values.shape
    data = np.where(np.isnan(values), nodata, values).astype("<f8")
    strips = [zlib.compress(data[r : r + 64].tobytes(), 6) for r in range(0, rows, 64)]
    text = f"{nodata}\0".encode()
    entries: list[tuple[int, int, list]] = [
        (256, 4, [columns]), (257, 4, [rows]), (258, 3, [64]), (259, 3, [8]), (262, 3, [1]), (273, 4, [0] * len(strips)), (277, 3, [1]), (278, 4, [64]), (279, 4, [len(s) for s in strips]),
        (284, 3, [1]), (339, 3, [3]), (33550, 12, [size, size, 0.0]), (33922, 12, [0.0, 0.0, 0.0, west, north, 0.0]), (34735, 3, [1, 1, 0, 1, 1025, 0, 1, 1]), (42113, 2, list(text)),
    ]
    at = 8 + 2 + 12 * len(entries) + 4
    extra, where = b"", {}
    for tag, kind, own in entries:
        size_ = _TYPES[kind][1] * len(own)
        if size_ > 4:
            where[tag] = at + len(extra)
            extra += b"\0" * (size_ + size_ % 2)
    starts = np.cumsum([at + len(extra), *(len(s) for s in strips[:-1])]).tolist()
    pool = bytearray(extra)
    directory = struct.pack("<H", len(entries))
    for tag, kind, own in entries:
        own = starts if tag == 273 else own
        raw = bytes(own) if kind == 2 else struct.pack(f"<{len(own)}{_TYPES[kind][0]}", *own)
        if tag in where:
            pool[where[tag] - at : where[tag] - at + len(raw)] = raw
            raw = struct.pack("<I", where[tag])
        directory += struct.pack("<HHI", tag, kind, len(own)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + directory + b"\0\0\0\0" + bytes(pool) + b"".join(strips)


def _cells(name: str, content: bytes) -> Iterator[dict[str, object]]:
    for k, band in enumerate(bands(content), 1):
        for part in band.cells(name):
            yield part | {"band": np.full(len(part["row"]), k, np.int32)}


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, band, row, col, value of every file below the path."""
    return parsed(spark, path, "*.tif*", _cells, CELLS)


def headers(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, "*.tif*", lambda n, c: iter([bands(c)[0].header(n)]), HEADER)


def tags(spark: SparkSession, path: str) -> DataFrame:
    """file, tag and its values as text."""
    return parsed(spark, path, "*.tif*", lambda n, c: iter([{"file": [n] * len(t), "tag": list(t), "value": [", ".join(map(str, v)) for v in t.values()]} for t in [fields(c)[1]]]), "file string, tag int, value string")


def write(cells: DataFrame, path: str, north: float = 0.0, west: float = 0.0, size: float = 1.0, tile: int = 1024) -> int:
    """Files of at most ``tile`` rows and columns, named by their first row and column; their number."""

    def run(table: pa.Table) -> dict[str, bytes]:
        values, r0, c0 = block(table)
        return {f"{r0}_{c0}.tif": encode(values, north - r0 * size, west + c0 * size, size)}

    return written(tiles(cells, tile), ["tr", "tc"], path, run)
