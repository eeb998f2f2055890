"""Elevation rasters, shapefiles, and areas with holes and islands."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewind.operators import joins
from cubewind.sources import files, geotiff, shapefile


def tiff(path, x, order="<", tile=None, deflate=False, predictor=1, missing=None, origin=(-92.0, 1.0), step=0.01, big=False, strip=3):
    kind = x.dtype.newbyteorder(order)
    h, w = tile or (strip, x.shape[1])
    blocks = []
    for a in range(0, x.shape[0], h):
        for b in range(0, x.shape[1], w):
            part = x[a : a + h, b : b + w]
            if tile:
                part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype)).astype(part.dtype)
            raw = part.astype(kind).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    sample = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
    word = "Q" if big else "I"
    tags = [(256, "H", [x.shape[1]]), (257, "H", [x.shape[0]]), (258, "H", [x.dtype.itemsize * 8]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [sample]), (33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, *origin, 0.0])]
    tags += [(322, "H", [w]), (323, "H", [h])] if tile else [(278, "H", [h])]
    if missing is not None:
        tags.append((42113, "s", list(str(missing).encode() + b"\0")))
    first = 16 if big else 8
    at, places = first, []
    for b in blocks:
        places.append(at)
        at += len(b)
    tags += [(324 if tile else 273, word, places), (325 if tile else 279, word, [len(b) for b in blocks])]
    codes = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}
    room, entry = (8, 20) if big else (4, 12)
    ifd = at + at % 2
    extra, rows = b"", b""
    begin = ifd + (8 if big else 2) + entry * len(tags) + room
    for tag, code, values in sorted(tags):
        raw = bytes(values) if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        where = raw + bytes(room - len(raw)) if len(raw) <= room else struct.pack(f"{order}{word}", begin + len(extra))
        extra += raw if len(raw) > room else b""
        rows += struct.pack(f"{order}HH{word}", tag, codes[code], len(values)) + where
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, ifd) if big else struct.pack(f"{order}HI", 42, ifd))
    with open(path, "wb") as f:
        f.write(head + b"".join(blocks) + b"\0" * (at % 2) + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + rows + bytes(room) + extra)


RASTER = (np.arange(23 * 31).reshape(23, 31) * 7 % 1000 - 50).astype("i2")


@pytest.mark.parametrize(
    "more",
    [{}, {"order": ">", "deflate": True}, {"tile": (8, 16), "deflate": True, "predictor": 2}, {"tile": (16, 16), "big": True}, {"tile": (8, 8), "order": ">", "predictor": 2}],
)
def test_rasters(spark, tmp_path, more):
    tiff(f"{tmp_path}/a.tif", RASTER, missing=-50, **more)
    geotiff.register(spark)
    rows = spark.read.format("geotiff").option("path", f"{tmp_path}/a.tif").load().collect()
    assert len(rows) == RASTER.size
    for r in rows:
        v = int(RASTER[r["j"], r["i"]])
        assert r["value"] == (None if v == -50 else v)
        assert (r["lon"], r["lat"]) == pytest.approx((-92 + 0.01 * (r["i"] + 0.5), 1 - 0.01 * (r["j"] + 0.5)))


def test_tiles_outside_a_box_are_not_read(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).random((64, 64)).astype("f4")
    x[3, 3] = np.nan
    tiff(f"{tmp_path}/fine.tif", x, tile=(16, 16), deflate=True)
    tiff(f"{tmp_path}/coarse.tif", x[::4, ::4], step=0.04)
    rasters = {0.01: f"{tmp_path}/fine.tif", 0.04: f"{tmp_path}/coarse.tif"}
    got = files.open_elevation(spark, rasters, 0.012, (-91.90, -91.85), (0.75, 0.80), 0.02).collect()
    inside = [(j, i) for j in range(64) for i in range(64) if -91.92 <= -92 + 0.01 * (i + 0.5) <= -91.83 and 0.73 <= 1 - 0.01 * (j + 0.5) <= 0.82]
    assert sorted(r["elevation"] for r in got) == pytest.approx(sorted(float(x[k]) for k in inside))
    assert files.open_elevation(spark, rasters, 0.03, (-91.9, -91.8), (0.7, 0.8)).count() == 16 * 16
    from pyspark.sql.datasource import GreaterThan, LessThan

    reader = geotiff.TileReader([rasters[0.01]])
    list(reader.pushFilters([GreaterThan(("lon",), -91.92), LessThan(("lon",), -91.83), GreaterThan(("lat",), 0.73), LessThan(("lat",), 0.82)]))
    parts = reader.partitions()
    assert sum(len(p.numbers) for p in parts) == 2
    counted = []
    plain = geotiff.Raster
    monkeypatch.setattr(geotiff, "Raster", lambda p: counted.append(plain(p)) or counted[-1])
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == len(inside) and counted[0].opened == 2
    far = geotiff.TileReader([rasters[0.01]])
    list(far.pushFilters([GreaterThan(("lon",), 50.0)]))
    assert far.partitions() == []
    with pytest.raises(ValueError, match="isn't a TIFF"):
        (tmp_path / "x").write_bytes(b"no")
        plain(f"{tmp_path}/x")


def ring(cx, cy, r, n=8, turn=1, seed=0):
    rng = random.Random(seed)
    out = [(cx + r * (0.7 + 0.3 * rng.random()) * np.cos(turn * 2 * np.pi * k / n), cy + r * (0.7 + 0.3 * rng.random()) * np.sin(turn * 2 * np.pi * k / n)) for k in range(n)]
    return [(float(x), float(y)) for x, y in [*out, out[0]]]


def shapes(path, records, kind=5):
    """records: (parts, name)."""
    body, index, at = b"", b"", 100
    for k, (parts, _) in enumerate(records):
        if parts is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for part in parts for p in part]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            first = np.cumsum([0, *map(len, parts)])[:-1].tolist()
            content = struct.pack("<i4dii", kind, min(xs), min(ys), max(xs), max(ys), len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *first) + b"".join(struct.pack("<dd", *p) for p in points)
        body += struct.pack(">ii", k + 1, len(content) // 2) + content
        index += struct.pack(">ii", at // 2, len(content) // 2)
        at += 8 + len(content)
    for name, own in ((f"{path}.shp", body), (f"{path}.shx", index)):
        with open(name, "wb") as f:
            f.write(struct.pack(">i20xi", 9994, (100 + len(own)) // 2) + struct.pack("<ii64x", 1000, kind) + own)
    with open(f"{path}.dbf", "wb") as f:
        f.write(struct.pack("<B3xIHH20x", 3, len(records), 65, 13) + b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([12]) + bytes(15) + b"\r")
        f.write(b"".join(b" " + (n or "").encode().ljust(12) for _, n in records))


AREAS = [([ring(0, 0, 3, 40), ring(0, 0, 2, 20, -1, 1), ring(0.1, 0, 1, 10, 1, 2)], "atoll"), ([ring(5, 1, 1.5), ring(8, -1, 1, 5, 1, 3)], "two"), (None, "nothing"), ([[(20.0, 20.0), (21.0, 20.0), (21.0, 21.0), (20.0, 20.0)]], "far")]


def test_shapes(spark, tmp_path, monkeypatch):
    shapes(f"{tmp_path}/a", AREAS)
    got = {r["properties"]["NAME"]: r for r in files.open_shapes(spark, f"{tmp_path}/a.shp").collect()}
    assert set(got) == {"atoll", "two", "nothing", "far"} and got["nothing"]["rings"] is None and got["nothing"]["kind"] == "nothing"
    assert [[(p["x"], p["y"]) for p in part] for part in got["atoll"]["rings"]] == AREAS[0][0] and got["two"]["id"] == 2
    assert [r["id"] for r in files.open_shapes(spark, f"{tmp_path}/a.shp", (4, 9), (-2, 2)).collect()] == [2]
    from pyspark.sql.datasource import LessThanOrEqual

    reader = shapefile.ShapeReader([f"{tmp_path}/a.shp"])
    list(reader.pushFilters([LessThanOrEqual(("x_min",), 10.0)]))
    decoded = []
    plain = shapefile.parts
    monkeypatch.setattr(shapefile, "parts", lambda *a: decoded.append(1) or plain(*a))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 and len(decoded) == 2
    monkeypatch.setattr(shapefile, "PART_BYTES", 200)
    assert len(shapefile.ShapeReader([f"{tmp_path}/a.shp"]).partitions()) > 1
    shapes(f"{tmp_path}/l", [([[(0.0, 0.0), (1.0, 2.0)], [(3.0, 3.0), (4.0, 4.0)]], "line")], 3)
    line = files.open_shapes(spark, f"{tmp_path}/l.shp").first()
    assert line["kind"] == "line" and len(line["rings"]) == 2


def odd(x, y, rings):
    hit = 0
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]], strict=True):
            hit += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return hit % 2 == 1


def test_areas_with_holes_and_islands(spark, tmp_path):
    shapes(f"{tmp_path}/a", AREAS)
    areas = files.open_shapes(spark, f"{tmp_path}/a.shp").where("rings IS NOT NULL").select("id", "rings")
    rng = random.Random(3)
    points = [(k, rng.uniform(-4, 10), rng.uniform(-4, 4)) for k in range(600)] + [(600, 0.1, 0.0), (601, None, 0.0), (0, 0.1, 0.0), (600, 0.1, 0.0), (602, 20.0, 20.0)]
    df = spark.createDataFrame(points, "k int, lon double, lat double")
    want = sorted((k, n + 1) for k, x, y in points if x is not None for n, (rings, _) in enumerate(AREAS) if rings and odd(x, y, rings))
    for cell in (0.05, 3.0):
        assert sorted((r["k"], r["id"]) for r in joins.points_in_areas(df, areas, cell).collect()) == want
    assert len(want) > 100 and want.count((600, 1)) == 2
    # lines: in a hole, on an island, across
    lines = {"hole": [(1.2, 0.3), (1.2, -0.3)], "island": [(0.1, 0.0), (0.2, 0.1)], "across": [(-4.0, 0.0), (9.0, 0.0)], "beside": [(0.0, 3.5), (4.0, 3.5)]}
    table = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in p]) for n, p in lines.items()], "name string, points array<struct<x: double, y: double>>")
    met = sorted((r["name"], r["id"]) for r in joins.features_in_polygons(table, areas, 0.7).collect())
    assert met == [("across", 1), ("across", 2), ("island", 1)]
    assert joins.points_in_areas(df, areas.limit(0)).count() == 0
    assert joins.points_in_areas(df.limit(0), areas).columns == ["k", "lon", "lat", "id"]
    plan = joins.points_in_areas(df, areas)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert areas.agg(F.count("*")).first()[0] == 3
