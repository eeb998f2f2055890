"""GeoTIFF rasters as a Spark data source: spark.read.format("geotiff").option("path", glob).

Columns: path, j, i (rows from the top), lon, lat (middle of the pixel, in the raster's own coordinates) and value. A partition is
a run of tiles or strips. Bounds on lon, lat, j and i are pushed down: tiles outside them are neither dealt to tasks nor read.
Read are TIFF and BigTIFF in either byte order, one band of integers or floats, plain or deflated, with or without horizontal
differences. The missing value of the file and NaN are NULL. Other compressions are an error.
"""

from __future__ import annotations

import glob
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cubewind.sources.bounds import BoundedReader

#: Pixels that a task reads, about
PART_PIXELS = 8_000_000
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class Raster:
    """The first image of a file: its size, place and tiles."""

    def __init__(self, path: str):
        self.path, self.opened = path, 0
        with open(path, "rb") as f:
            head = f.read(16)
            if head[:2] not in (b"II", b"MM"):
                raise ValueError(f"{path} isn't a TIFF file")
            self.order = "<" if head[:2] == b"II" else ">"
            self.big = struct.unpack_from(f"{self.order}H", head, 2)[0] == 43
            at = struct.unpack_from(f"{self.order}{'Q' if self.big else 'I'}", head, 8 if self.big else 4)[0]
            tags = self._tags(f, at)
        one = lambda k, default: tags.get(k, [default])[0]
        self.width, self.height, self.compression, self.predictor = one(256, 0), one(257, 0), one(259, 1), one(317, 1)
        if one(277, 1) != 1 or self.compression not in (1, 8, 32946) or self.predictor not in (1, 2):
            raise ValueError(f"{path}: {one(277, 1)} bands, compression {self.compression} or predictor {self.predictor} aren't read")
        self.kind = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[one(339, 1)] }{one(258, 8) // 8}")
        tiled = 324 in tags
        self.tile = (one(323, 0), one(322, 0)) if tiled else (min(one(278, self.height), self.height), self.width)
        self.tiled, self.offsets, self.counts = tiled, tags[324 if tiled else 273], tags[325 if tiled else 279]
        self.across = -(-self.width // self.tile[1])
        scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
        half = 0.0 if one(1025, 1) == 2 else 0.5
        self.lon = tie[3] + (np.arange(self.width) + half - tie[0]) * scale[0]
        self.lat = tie[4] - (np.arange(self.height) + half - tie[1]) * scale[1]
        missing = tags.get(42113)
        self.missing = float(bytes(missing).split(b"\0")[0]) if missing else None

    def _tags(self, f, at: int) -> dict[int, tuple]:
        wide, order, out = self.big, self.order, {}
        f.seek(at)
        n = struct.unpack(f"{order}{'Q' if wide else 'H'}", f.read(8 if wide else 2))[0]
        size, room = (20, 8) if wide else (12, 4)
        rows = f.read(n * size)
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HH{'Q' if wide else 'I'}", rows, k * size)
            length = _SIZES.get(kind, 1) * count
            raw = rows[k * size + size - room : k * size + size]
            if length > room:
                f.seek(struct.unpack(f"{order}{'Q' if wide else 'I'}", raw)[0])
                raw = f.read(length)
            if kind == 2:
                out[tag] = tuple(raw[:length])
            elif kind in _CODES:
                out[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", raw)
        keys = out.get(34735, ())
        out |= {keys[k]: (keys[k + 3],) for k in range(4, len(keys) - 3, 4) if keys[k] == 1025 and keys[k + 1] == 0}  # where in a pixel its place is
        return out

    def read(self, number: int) -> tuple[int, int, np.ndarray]:
        """First row and column of a tile, and its pixels inside the image."""
        self.opened += 1
        with open(self.path, "rb") as f:
            f.seek(self.offsets[number])
            raw = f.read(self.counts[number])
        if self.compression != 1:
            raw = zlib.decompress(raw)
        top, left = number // self.across * self.tile[0], number % self.across * self.tile[1]
        rows = self.tile[0] if self.tiled else min(self.tile[0], self.height - top)
        x = np.frombuffer(raw, self.kind, rows * self.tile[1]).reshape(rows, self.tile[1])
        if self.predictor == 2:
            x = np.cumsum(x, axis=1, dtype=self.kind.newbyteorder("="))
        return top, left, x[: self.height - top, : self.width - left]


@dataclass
class Tiles(InputPartition):
    path: str
    numbers: list[int]


class GeoTIFF(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, j int, i int, lon double, lat double, value double"

    def reader(self, schema) -> DataSourceReader:
        paths = sorted(glob.glob(self.options["path"]))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return TileReader(paths)


class TileReader(BoundedReader):
    columns = ("j", "i", "lon", "lat")

    def __init__(self, paths: list[str]):
        super().__init__()
        self.paths = paths

    def _box(self, r: Raster) -> tuple[tuple[int, int], tuple[int, int]]:
        both = lambda axis, place, c: tuple(f(a, b) for f, a, b in zip((max, min), self.within(np.arange(len(axis)), c), self.within(axis, place), strict=True))
        return both(r.lat, "lat", "j"), both(r.lon, "lon", "i")

    def partitions(self) -> list[Tiles]:
        out = []
        for path in self.paths:
            r = Raster(path)
            (j0, j1), (i0, i1) = self._box(r)
            h, w = r.tile
            inside = [y * r.across + x for y in range(j0 // h, -(-j1 // h)) for x in range(i0 // w, -(-i1 // w))] if j0 < j1 and i0 < i1 else []
            step = max(1, PART_PIXELS // (h * w))
            out += [Tiles(path, inside[k : k + step]) for k in range(0, len(inside), step)]
        return out

    def read(self, part: Tiles | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions
            return
        r = Raster(part.path)
        (j0, j1), (i0, i1) = self._box(r)
        for number in part.numbers:
            top, left, x = r.read(number)
            a, z, b, y = max(j0 - top, 0), min(j1 - top, len(x)), max(i0 - left, 0), min(i1 - left, x.shape[1])
            if a >= z or b >= y:
                continue
            x = x[a:z, b:y].astype(float)
            gone = np.isnan(x) | (x == r.missing if r.missing is not None else False)
            j, i = np.repeat(np.arange(top + a, top + z), y - b), np.tile(np.arange(left + b, left + y), z - a)
            yield pa.record_batch(
                [pa.array([part.path] * len(j)), pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(r.lon[i]), pa.array(r.lat[j]), pa.array(x.reshape(-1), pa.float64(), mask=gone.reshape(-1))],
                names=["path", "j", "i", "lon", "lat", "value"],
            )


def register(spark) -> None:
    """With push-down of filters, which Spark has switched off for Python sources by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTIFF)
