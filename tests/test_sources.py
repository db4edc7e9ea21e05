"""Files of each format: exact round trips, and files made by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.sources import geotiff, grids, las, shapefile


def raster(spark, rows=70, columns=45):
    rng = np.random.default_rng(1)
    values = np.where(rng.random((rows, columns)) < 0.1, np.nan, rng.normal(0, 100, (rows, columns)))
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "row int, col int, value double")


def rows(df):
    return sorted(map(tuple, df.select("row", "col", "value").collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("kind", ["arc", "grass", "surfer"])
def test_grids_come_back(spark, tmp_path, kind):
    cells = raster(spark)
    assert grids.write(cells, str(tmp_path), kind, north=500.0, west=20.0, size=2.0, tile=32) == 6
    heads = grids.headers(spark, str(tmp_path), kind)
    assert {(r["rows"], r["columns"]) for r in heads.collect()} == {(32, 32), (32, 13), (6, 32), (6, 13)}
    assert heads.agg(F.max("north"), F.min("west"), F.min("south"), F.max("east")).first() == (500.0, 20.0, 360.0, 110.0)
    assert rows(grids.merged(grids.read(spark, str(tmp_path), kind), heads, 500.0, 20.0, 2.0)) == rows(cells)


def test_arc_header_by_centres_and_bad_files(spark, tmp_path):
    (tmp_path / "a.asc").write_text("NCOLS 2\nNROWS 2\nXLLCENTER 1\nYLLCENTER 1\nCELLSIZE 2\n1 2\n-9999 4\n")
    assert rows(grids.read(spark, str(tmp_path))) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 4.0)]
    assert grids.headers(spark, str(tmp_path)).select("north", "west").first() == (4.0, 0.0)
    with pytest.raises(ValueError):
        grids.parse_arc("b", b"ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\n1 2 3\n")


def test_geotiff_comes_back(spark, tmp_path):
    cells = raster(spark)
    assert geotiff.write(cells, str(tmp_path), north=500.0, west=20.0, size=2.0, tile=40) == 4
    back = geotiff.read(spark, str(tmp_path))
    assert {r["band"] for r in back.select("band").distinct().collect()} == {1}
    assert rows(grids.merged(back, geotiff.headers(spark, str(tmp_path)), 500.0, 20.0, 2.0)) == rows(cells)
    assert geotiff.tags(spark, str(tmp_path)).where("tag = 259").select("value").distinct().first()[0] == "8"


def lzw(data):
    """Literal codes only, a clear before the table outgrows nine bits."""
    bits = "".join(f"{x:09b}" for i in range(0, len(data), 200) for x in [256, *data[i : i + 200]]) + f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("how", ["plain", "deflate", "lzw", "packbits", "differences", "tiles", "two bands"])
def test_geotiff_kinds(order, how):
    rng = np.random.default_rng(2)
    bands = 2 if how == "two bands" else 1
    want = rng.integers(0, 60_000, (5, 7, bands))
    data = want.astype(f"{order}u2")
    if how == "differences":
        data = np.diff(data.astype(np.int64), axis=1, prepend=0).astype(f"{order}u2")
    if how == "tiles":
        parts = [np.pad(data, ((0, 3), (0, 1), (0, 0)))[r : r + 4] for r in (0, 4)]
        where = [(322, 4, [8]), (323, 4, [4])]
    else:
        parts, where = [data[:3], data[3:]], [(278, 4, [3])]
    pack = {"deflate": zlib.compress, "lzw": lzw, "packbits": lambda b: b"".join(bytes([0, x]) for x in b)}.get(how, bytes)
    strips = [pack(p.tobytes()) for p in parts]
    starts = [1000 + sum(map(len, strips[:i])) for i in range(len(strips))]
    tags = [(256, 4, [7]), (257, 4, [5]), (258, 3, [16]), (259, 3, [{"deflate": 8, "lzw": 5, "packbits": 32773}.get(how, 1)]), (277, 3, [bands]), (317, 3, [2 if how == "differences" else 1]), *where]
    tags += [(324 if how == "tiles" else 273, 4, starts), (325 if how == "tiles" else 279, 4, [len(s) for s in strips])]
    out, pool = bytearray(1000), 400
    out[:10] = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, len(tags))
    for i, (tag, kind, values) in enumerate(sorted(tags)):
        raw = struct.pack(f"{order}{len(values)}{'HI'[kind - 3]}", *values)
        if len(raw) > 4:
            out[pool : pool + len(raw)], raw, pool = raw, struct.pack(order + "I", pool), pool + len(raw)
        out[10 + 12 * i : 22 + 12 * i] = struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    got = geotiff.bands(bytes(out) + b"".join(strips))
    assert np.array_equal(np.stack([g.values for g in got], axis=2), want)


@pytest.mark.parametrize("data", [b"abc", b"aaaaaaaaaaaaaaaaaaaaaaaa", bytes(range(256)) * 40, b"abababab" * 3000])
def test_lzw_reads_what_an_encoder_writes(data):
    """A plain encoder that grows its codes as the format says."""
    table, bits, width, now = {bytes([i]): i for i in range(256)}, [f"{256:09b}"], 9, b""
    nxt = 258
    for x in data:
        if now + bytes([x]) in table:
            now += bytes([x])
            continue
        bits.append(f"{table[now]:0{width}b}")
        table[now + bytes([x])] = nxt
        nxt += 1
        width = 12 if nxt > 2047 else 11 if nxt > 1023 else 10 if nxt > 511 else 9
        now = bytes([x])
        if nxt == 4094:
            bits += [f"{table[now]:0{width}b}", f"{256:0{width}b}"]
            table, width, now, nxt = {bytes([i]): i for i in range(256)}, 9, b"", 258
    bits += [f"{table[now]:0{width}b}"] if now else []
    nxt += bool(now)
    width = 12 if nxt > 2047 else 11 if nxt > 1023 else 10 if nxt > 511 else 9
    text = "".join(bits) + f"{257:0{width}b}"
    text += "0" * (-len(text) % 8)
    assert geotiff._lzw(int(text, 2).to_bytes(len(text) // 8, "big")) == data


def test_shapefiles_come_back(spark, tmp_path):
    point = "array<struct<x:double,y:double>>"
    data = [
        (1, 5, [0, 4], [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (0.0, 0.0), (1.0, 2.0), (2.0, 2.0), (1.0, 1.0), (1.0, 2.0)], "résumé", 7, 1.5, True),
        (2, 5, [0], [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (5.0, 5.0)], None, None, None, None),
        (3, 1, [0], [(0.1, -7.25)], "p", -3, 1e-7, False),
        (100_001, 3, [0, 2], [(0.0, 1.0), (1.0, 1.0), (4.0, 4.0), (5.0, 7.0)], "", 2**40, -0.5, True),
        (100_002, 8, [0], [(0.0, 1.0), (3.5, 1.0)], "m", 1, 2.0, None),
    ]
    frame = spark.createDataFrame(data, f"fid long, shape_type int, parts array<int>, points {point}, name string, n long, v double, ok boolean")
    assert shapefile.write(frame, str(tmp_path)) == 4
    got = {int(r["attributes"]["fid"]): r for r in shapefile.read(spark, str(tmp_path)).collect()}
    assert set(got) == {d[0] for d in data}
    for fid, kind, parts, points, name, n, v, ok in data:
        r, a = got[fid], got[fid]["attributes"]
        assert (r["shape_type"], r["parts"], [tuple(p) for p in r["points"]]) == (kind, parts, points)
        assert a["name"] == (name or None) and a["n"] == (None if n is None else str(n)) and a["ok"] == (None if ok is None else "FT"[ok])
        assert (a["v"] is None and v is None) or float(a["v"]) == v


def test_las_comes_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, round(float(x), 3), round(float(y), 3), round(float(z), 3), i % 900, 1 + i % 3, 3, i % 20, float(i % 60 - 30), i % 5, i / 7, i % 256) for i, (x, y, z) in enumerate(rng.uniform(-500, 500, (2500, 3)))]
    frame = spark.createDataFrame(data, "pid long, x double, y double, z double, intensity int, ret int, n_ret int, class int, scan_angle double, source_id int, gps double, red int")
    frame = frame.withColumns({"green": F.col("red"), "blue": F.lit(None).cast("int")})
    assert las.write(frame, f"{tmp_path}/c", per_file=1000) == 3
    names = ["x", "y", "z", "intensity", "ret", "n_ret", "class", "scan_angle", "source_id", "gps", "red"]
    got = {r["file"]: r["n"] for r in las.read(spark, f"{tmp_path}/c").groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert got == {"0.las": 1000, "1.las": 1000, "2.las": 500}
    back = sorted((int(r["file"][0]) * 1000 + r["pid"], *[r[n] for n in names]) for r in las.read(spark, f"{tmp_path}/c").collect())
    assert [b[0] for b in back] == list(range(2500))
    assert np.allclose([b[1:] for b in back], [d[1:] for d in data], atol=5e-4)
    h = las.headers(spark, f"{tmp_path}/c").where("file = '2.las'").first()
    assert (h["version"], h["point_format"], h["number_of_points"]) == ("1.2", 3, 500)
    assert h["min_x"] == pytest.approx(min(d[1] for d in data[2000:])) and h["max_z"] == pytest.approx(max(d[3] for d in data[2000:]))


def test_las_of_format_six():
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<BHI", head, 104, 6, 32, 0)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 0.0, 0.0)
    struct.pack_into("<Q", head, 247, 1)
    point = struct.pack("<iiiHBBBBhHd", 5, 6, -7, 9, 2 | 4 << 4, 0, 65, 3, 1000, 12, 1.25)
    point += b"\0" * (32 - len(point))
    (got,) = las._points("a", bytes(head) + point)
    assert (got["x"][0], got["z"][0], got["ret"][0], got["n_ret"][0], got["class"][0], got["scan_angle"][0], got["gps"][0].as_py()) == (100.05, -0.07, 2, 4, 65, 6.0, 1.25)


def test_empty_tables_write_nothing(spark, tmp_path):
    assert grids.write(raster(spark).where("false"), str(tmp_path / "g")) == 0
    assert las.write(spark.createDataFrame([], "pid long, x double, y double, z double"), str(tmp_path / "l")) == 0
