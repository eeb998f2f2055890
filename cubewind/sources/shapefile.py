"""Shapefiles as a Spark data source: spark.read.format("shapefile").option("path", glob of .shp).

Columns: path, id (from 1), kind (point, line, area or nothing), x_min, x_max, y_min, y_max, parts (the rings of an area, holes
among them, or the pieces of a line; arrays of x and y) and properties (of the table beside it, as strings). A partition is a run
of records, found by the index (.shx) beside the file. Bounds on the box are pushed down: points of shapes outside aren't decoded.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cubewind.sources.bounds import BoundedReader

PART_BYTES = 16_000_000
_BOX = ("x_min", "y_min", "x_max", "y_max")
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_FIELDS = [("path", pa.string()), ("id", pa.int32()), ("kind", pa.string()), *[(c, pa.float64()) for c in ("x_min", "x_max", "y_min", "y_max")], ("parts", pa.list_(pa.list_(_POINT))), ("properties", pa.map_(pa.string(), pa.string()))]


class Table:
    """The records of a .dbf file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(32)
            self.count, self.first, self.size = struct.unpack_from("<IHH", head, 4)
            fields = f.read(self.first - 32)
        self.fields, at = [], 1
        for k in range(0, len(fields) - 31, 32):
            if fields[k] == 13:
                break
            length = fields[k + 16]
            self.fields.append((fields[k : k + 11].split(b"\0")[0].decode(), at, length))
            at += length

    def read(self, first: int, last: int) -> list[dict[str, str]]:
        with open(self.path, "rb") as f:
            f.seek(self.first + first * self.size)
            b = f.read((last - first) * self.size)
        rows = [b[k : k + self.size] for k in range(0, len(b), self.size)]
        return [{n: r[a : a + w].decode(errors="replace").strip() for n, a, w in self.fields} for r in rows]


def shape(b: bytes) -> tuple[str, tuple[float, ...] | None, tuple[int, int, int] | None]:
    """Kind, box, and number of parts, number of points and where parts begin, of a record's content."""
    kind = struct.unpack_from("<i", b)[0] % 10
    if kind == 1:
        x, y = struct.unpack_from("<dd", b, 4)
        return "point", (x, y, x, y), None
    if kind in (3, 5):
        return "line" if kind == 3 else "area", struct.unpack_from("<4d", b, 4), (*struct.unpack_from("<ii", b, 36), 44)
    if kind == 8:
        return "point", struct.unpack_from("<4d", b, 4), (0, struct.unpack_from("<i", b, 36)[0], 40)
    return "nothing", None, None


def parts(b: bytes, box: tuple[float, ...], layout: tuple[int, int, int] | None) -> list[list[dict[str, float]]]:
    if layout is None:
        return [[{"x": box[0], "y": box[1]}]]
    count, points, at = layout
    first = [*struct.unpack_from(f"<{count}i", b, at), points] if count else [0, points]
    xy = np.frombuffer(b, "<f8", 2 * points, at + 4 * count).reshape(-1, 2).tolist()
    return [[{"x": x, "y": y} for x, y in xy[a:z]] for a, z in zip(first, first[1:], strict=False)]


@dataclass
class Shapes(InputPartition):
    path: str
    first: int
    last: int


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "path string, id int, kind string, x_min double, x_max double, y_min double, y_max double, parts array<array<struct<x: double, y: double>>>, properties map<string, string>"

    def reader(self, schema) -> DataSourceReader:
        paths = sorted(glob.glob(self.options["path"]))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return ShapeReader(paths)


class ShapeReader(BoundedReader):
    columns = ("x_min", "x_max", "y_min", "y_max", "id")

    def __init__(self, paths: list[str]):
        super().__init__()
        self.paths = paths

    @staticmethod
    def _index(path: str) -> np.ndarray:
        """Offset and length in bytes of each record's content."""
        with open(f"{path.removesuffix('.shp')}.shx", "rb") as f:
            f.seek(100)
            return np.frombuffer(f.read(), ">i4").reshape(-1, 2).astype(np.int64) * 2 + [8, 0]

    def partitions(self) -> list[Shapes]:
        out = []
        for path in self.paths:
            index = self._index(path)
            a, z = self.within(np.arange(1, len(index) + 1), "id")
            run = (np.cumsum(index[a:z, 1]) // PART_BYTES) if z > a else np.zeros(0)
            cuts = [a, *(a + np.flatnonzero(np.diff(run)) + 1).tolist(), z]
            out += [Shapes(path, int(x), int(y)) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
        return out

    def read(self, part: Shapes | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions
            return
        index = self._index(part.path)[part.first : part.last]
        table = f"{part.path.removesuffix('.shp')}.dbf"
        properties = Table(table).read(part.first, part.last) if os.path.exists(table) else []
        with open(part.path, "rb") as f:
            for k, (at, size) in enumerate(index.tolist()):
                f.seek(at)
                b = f.read(size)
                kind, box, layout = shape(b)
                named = dict(zip(_BOX, box, strict=True)) if box else dict.fromkeys(_BOX)
                if any(c in self.bounds and (x is None or not self.bounds[c][0] <= x <= self.bounds[c][1]) for c, x in named.items()):
                    continue
                own = properties[k] if k < len(properties) else {}
                row = {"path": part.path, "id": part.first + k + 1, "kind": kind, **named, "parts": parts(b, box, layout) if box else None, "properties": list(own.items())}
                yield pa.RecordBatch.from_pylist([row], pa.schema(_FIELDS))


def register(spark) -> None:
    """With push-down of filters, which Spark has switched off for Python sources by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shapefile)
