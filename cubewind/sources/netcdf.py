"""NetCDF files as Spark data sources, and classic NetCDF as a sink.

spark.read.format("netcdf").option("path", glob) reads classic files (CDF-1, CDF-2, CDF-5) and NetCDF-4, which is HDF5 inside;
"netcdf-classic" is the same under its older name. Options: path (local or mounted; a glob), variable (default: the last).
Columns: time, level, j, i and the variable. Packed values are unpacked (scale_factor, add_offset). _FillValue, missing_value and
NaN are NULL; both are packed values.

A partition is a run of records of a file, whole chunks of about PART_BYTES, so a file is read by many tasks, each of which seeks
to its own. Bounds on time, level, j and i are pushed down: partitions outside them aren't made, and what a task opens are only
the chunks (in classic files the levels of records) inside. Filters stay in the plan, as bounds are coarse for some.

df.write.format("netcdf") writes one variable of a regular cube to one file on a mounted folder; see write_netcdf in sinks.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cubewind.sources import hdf5
from cubewind.sources.bounds import BoundedReader

#: Values of a variable that one task reads, in bytes as they are stored, about
PART_BYTES = 32_000_000
#: Files whose headers are read at once
OPENERS = 32

_KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    attributes: dict
    kind: np.dtype
    begin: int
    size: int
    record: bool
    chunks: tuple[int, ...] | None = None


class Header:
    """Dimensions, attributes and variables of a file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            self._f = f
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} isn't a classic NetCDF file")
            self._wide, self._offset = magic[3] == 5, magic[3] != 1
            self.records = self._n()
            self.dims = [(self._name(), self._n()) for _ in range(self._list())]
            self.attributes = self._attributes()
            raw = []
            for _ in range(self._list()):
                name = self._name()
                ids = [self._n() for _ in range(self._n())]
                attributes = self._attributes()
                kind = np.dtype(_KINDS[self._i()])
                size = self._n()
                raw.append((name, ids, attributes, kind, size, struct.unpack(">q", f.read(8))[0] if self._offset else self._i()))
        self.variables = {}
        for name, ids, attributes, kind, size, begin in raw:
            record = bool(ids) and self.dims[ids[0]][1] == 0
            shape = tuple(self.records if self.dims[k][1] == 0 else self.dims[k][1] for k in ids)
            self.variables[name] = Variable(name, tuple(self.dims[k][0] for k in ids), shape, attributes, kind, begin, size, record)
        records = [v for v in self.variables.values() if v.record]
        # sizes are padded to four bytes, but for a record variable that is the only one
        self.record_size = int(np.prod(records[0].shape[1:], dtype=np.int64)) * records[0].kind.itemsize if len(records) == 1 else sum(v.size for v in records)

    def _i(self) -> int:
        return struct.unpack(">i", self._f.read(4))[0]

    def _n(self) -> int:
        return struct.unpack(">q", self._f.read(8))[0] if self._wide else self._i()

    def _name(self) -> str:
        n = self._n()
        return self._f.read(n + -n % 4)[:n].decode()

    def _list(self) -> int:
        self._i()
        return self._n()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind = self._name(), np.dtype(_KINDS[self._i()])
            n = self._n() * kind.itemsize
            data = self._f.read(n + -n % 4)[:n]
            out[name] = data.decode(errors="replace") if kind == "S1" else np.frombuffer(data, kind)
        return out

    def read(self, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """The part of a variable from first to last along its first dimension; nothing else is read."""
        v = self.variables[name]
        if not v.shape:
            first, last = 0, 1
        last = (v.shape[0] if v.shape else 1) if last is None else last
        per = int(np.prod(v.shape[1:], dtype=np.int64)) * v.kind.itemsize
        with open(self.path, "rb") as f:
            if not v.record:
                f.seek(v.begin + first * per)
                return np.frombuffer(f.read((last - first) * per), v.kind).reshape((last - first, *v.shape[1:]) if v.shape else ())
            out = bytearray()
            for k in range(first, last):
                f.seek(v.begin + k * self.record_size)
                out += f.read(per)
            return np.frombuffer(bytes(out), v.kind).reshape(last - first, *v.shape[1:])


    def box(self, name: str, box: hdf5.Box) -> np.ndarray:
        """The values of a box; of each record only the planes inside the second dimension's bounds are read."""
        v = self.variables[name]
        if len(box) < 3 or box[1] == (0, v.shape[1]):
            return self.read(name, *box[0])[(slice(None), *[slice(*x) for x in box[1:]])]
        plane = int(np.prod(v.shape[2:], dtype=np.int64)) * v.kind.itemsize
        step = self.record_size if v.record else plane * v.shape[1]
        out = bytearray()
        with open(self.path, "rb") as f:
            for k in range(*box[0]):
                f.seek(v.begin + k * step + box[1][0] * plane)
                out += f.read((box[1][1] - box[1][0]) * plane)
        rows = np.frombuffer(bytes(out), v.kind).reshape(box[0][1] - box[0][0], box[1][1] - box[1][0], *v.shape[2:])
        return rows[(slice(None), slice(None), *[slice(*x) for x in box[2:]])]


def opened(path: str) -> Header | hdf5.File:
    with open(path, "rb") as f:
        own = f.read(8) == hdf5.SIGNATURE
    return hdf5.File(path) if own else Header(path)


def first_of(pattern: str) -> str:
    paths = sorted(glob.glob(pattern))
    if not paths:
        raise FileNotFoundError(pattern)
    return paths[0]


def values(file: Header | hdf5.File, name: str, box: hdf5.Box | None = None) -> np.ndarray:
    box = [(0, n) for n in file.variables[name].shape] if box is None else box
    return file.read(name, box) if isinstance(file, hdf5.File) else file.box(name, box) if box else file.read(name)


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def times(file: Header | hdf5.File) -> np.ndarray:
    """The time axis, by its units."""
    kind, _, start = str(file.variables["time"].attributes["units"]).partition(" since ")
    seconds = _SECONDS[kind.strip().lower().removesuffix("s")]
    since = np.datetime64(start.strip()[:19].replace(" ", "T"), "us")
    return since + np.round(values(file, "time").astype(float) * seconds * 1e6).astype("timedelta64[us]")


@dataclass
class Records(InputPartition):
    path: str
    first: int
    last: int


class NetCDF(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _paths(self) -> list[str]:
        paths = sorted(glob.glob(self.options["path"]))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return paths

    def _variable(self) -> str:
        return self.options.get("variable") or list(opened(self._paths()[0]).variables)[-1]

    def schema(self) -> str:
        return f"time timestamp_ntz, level int, j int, i int, `{self._variable()}` double"

    def reader(self, schema) -> DataSourceReader:
        return GridReader(self._paths(), self._variable())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite and os.path.exists(self.options["path"]):
            raise FileExistsError(self.options["path"])
        return RecordWriter(dict(self.options))


class ClassicNetCDF(NetCDF):
    @classmethod
    def name(cls) -> str:
        return "netcdf-classic"


class GridReader(BoundedReader):
    """Reads partitions of cubes."""

    columns = ("time", "level", "j", "i")

    def __init__(self, paths: list[str], variable: str, part_bytes: int | None = None):
        super().__init__()
        self.paths, self.variable, self.part_bytes = paths, variable, part_bytes or PART_BYTES

    def partitions(self) -> list[Records]:
        with ThreadPoolExecutor(OPENERS) as pool:
            return [p for own in pool.map(self._parts, self.paths) for p in own]

    def _parts(self, path: str) -> list[Records]:
        file = opened(path)
        v = file.variables[self.variable]
        if "time" not in v.dims:
            return [] if "time" in self.bounds else [Records(path, 0, 1)]
        first, last = self.within(times(file).astype(np.int64).astype(float), "time")
        step = v.chunks[0] if v.chunks else 1
        per = step * max(1, self.part_bytes // max(1, step * int(np.prod(v.shape[1:], dtype=np.int64)) * v.kind.itemsize))
        return [Records(path, max(k, first), min(k + per, last)) for k in range(first // step * step, last, per)]

    def read(self, part: Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions
            return
        file = opened(part.path)
        v = file.variables[self.variable]
        timed = "time" in v.dims
        at = times(file) if timed else np.array(["NaT"], "datetime64[us]")
        shape = v.shape[1:] if timed else v.shape
        levels: list[int | None] = [None]
        box = [(part.first, part.last)] if timed else []
        if len(shape) == 3:
            own = v.dims[-3]
            levels = values(file, own).astype(int).tolist() if own in file.variables else list(range(shape[0]))
            box.append(self.within(np.array(levels, float), "level"))
            levels = levels[slice(*box[-1])]
        elif "level" in self.bounds:
            return
        (j0, j1), (i0, i1) = (self.within(np.arange(n, dtype=float), c) for n, c in zip(shape[-2:], "ji", strict=True))
        box += [(j0, j1), (i0, i1)]
        if any(a >= z for a, z in box):
            return
        number = lambda name, default: float(np.ravel(v.attributes.get(name, default))[0])
        scale, offset = number("scale_factor", 1.0), number("add_offset", 0.0)
        missing = [float(x) for name in ("_FillValue", "missing_value") for x in np.ravel(v.attributes.get(name, []))]
        j, i = np.repeat(np.arange(j0, j1), i1 - i0), np.tile(np.arange(i0, i1), j1 - j0)
        step = v.chunks[0] if v.chunks else 1
        runs = [(t, min((t // step + 1) * step, part.last)) for t in range(part.first // step * step, part.last, step)] if timed else [(0, 1)]
        for a, z in runs:  # a row of chunks at once
            a = max(a, part.first)
            data = values(file, self.variable, [(a, z), *box[1:]] if timed else box).reshape(z - a, len(levels), -1)
            for t in range(z - a):
                for k, level in enumerate(levels):
                    x = data[t, k].astype(float)
                    gone = np.isnan(x) | np.isin(x, missing)
                    n = len(x)
                    yield pa.record_batch(
                        [pa.array(np.repeat(at[a + t if timed else 0], n)), pa.array([level] * n, pa.int32()), pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(x * scale + offset, pa.float64(), mask=gone)],
                        names=["time", "level", "j", "i", self.variable],
                    )


def layout(variable: str, kind: str, records: int, nj: int, ni: int, level: list[int] | None, attributes: dict, own: dict, coordinates: dict[str, np.ndarray], since: str) -> tuple[bytes, int]:
    """Header and fixed part of a 64-bit classic file, and bytes of a record: its time, then its values."""
    dims = [("time", 0), *([("pressure", len(level))] if level else []), ("south_north", nj), ("west_east", ni)]
    number = {k: n for n, (k, _) in enumerate(dims)}
    name = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)

    def listed(given: dict) -> bytes:
        out = b""
        for k, x in given.items():
            raw, code, n = (np.asarray(x, ">f8").tobytes(), 6, np.size(x)) if not isinstance(x, str) else (x.encode(), 2, len(x.encode()))
            out += name(k) + struct.pack(">ii", code, n) + raw + b"\0" * (-len(raw) % 4)
        return struct.pack(">ii", 12 if given else 0, len(given)) + out

    fixed = {k: np.asarray(x, ">f8") for k, x in coordinates.items()} | ({"pressure": np.asarray(level, ">f8")} if level else {})
    of = {"pressure": ("pressure",)}
    size = int(np.dtype(kind).itemsize) * nj * ni * (len(level) if level else 1)
    size += -size % 4
    code = {"f4": 5, "f8": 6}[kind[-2:]]

    def header(begin: int) -> bytes:
        out, at = b"", begin
        for k, x in fixed.items():
            ids = [number[d] for d in of.get(k, ("south_north", "west_east") if x.ndim == 2 else (k,))]
            out += name(k) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + listed({}) + struct.pack(">iiq", 6, x.nbytes, at)
            at += x.nbytes
        out += name("time") + struct.pack(">ii", 1, 0) + listed({"units": f"hours since {since}", "calendar": "standard"}) + struct.pack(">iiq", 6, 8, at)
        ids = list(range(len(dims)))
        out += name(variable) + struct.pack(f">i{len(ids)}i", len(ids), *ids) + listed(own) + struct.pack(">iiq", code, min(size, 2**31 - 4), at + 8)
        top = b"CDF\2" + struct.pack(">i", records) + struct.pack(">ii", 10, len(dims)) + b"".join(name(k) + struct.pack(">i", n) for k, n in dims)
        return top + listed(attributes) + struct.pack(">ii", 11, len(fixed) + 2) + out

    head = header(len(header(0)))
    return head + b"".join(x.tobytes() for x in fixed.values()), 8 + size


class RecordWriter(DataSourceArrowWriter):
    """Tasks put their records where they belong in one file under a name of its own; committing gives it its name, and a job
    that fails leaves nothing. A task that runs again writes the same bytes again. Rows: record (from 0) and values (the
    record's bytes); a record that no row has is all missing."""

    def __init__(self, options: dict):
        self.path, self.head, self.step, self.records = options["path"], bytes.fromhex(options["head"]), int(options["step"]), int(options["records"])
        self.axis, self.missing = json.loads(options["axis"]), options["missing"]
        self.own = f"{os.path.dirname(self.path) or '.'}/.{os.path.basename(self.path)}-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.own, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + self.step * self.records)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = []
        with open(self.own, "r+b") as f:
            for b in batches:
                for record, content in zip(b.column("record").to_pylist(), b.column("values").to_pylist(), strict=True):
                    f.seek(len(self.head) + record * self.step)
                    f.write(struct.pack(">d", self.axis[record]) + content)
                    done.append(record)
            f.flush()
            os.fsync(f.fileno())
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        there = {r for m in messages if m for r in m.records}
        with open(self.own, "r+b") as f:
            for k in sorted(set(range(self.records)) - there):
                f.seek(len(self.head) + k * self.step)
                f.write(struct.pack(">d", self.axis[k]) + np.full((self.step - 8) // np.dtype(self.missing).itemsize, np.nan, self.missing).tobytes())
        os.replace(self.own, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.own):
            os.remove(self.own)


@dataclass
class Written(WriterCommitMessage):
    records: list[int]


def register(spark) -> None:
    """Both names, with push-down of filters, which Spark has switched off for Python sources by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (NetCDF, ClassicNetCDF):
        spark.dataSource.register(source)
