"""HDF5 files as far as NetCDF-4 uses them: groups, attributes, and contiguous or chunked arrays with deflate and shuffle.

A box of an array is read by walking the chunk index only where it meets the box; no other chunk is opened. Read are superblocks
0 to 3, object headers 1 and 2, links and attributes in headers, symbol tables or fractal heaps, layouts up to version 3 with
their B-tree, and fixed or variable strings. Newer chunk indexes, other filters and compound values are an error where they are
needed, and None as attributes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
_NONE = 2**64 - 1
Box = list[tuple[int, int]]


@dataclass
class Array:
    """A variable: where and how its values are stored."""

    name: str
    shape: tuple[int, ...]
    kind: np.dtype
    attributes: dict
    dims: tuple[str, ...] = ()
    chunks: tuple[int, ...] | None = None
    layout: int = 1
    address: int = _NONE
    filters: list[int] = field(default_factory=list)
    fill: bytes = b""
    inline: bytes = b""


def _number(b: bytes, at: int, size: int) -> int:
    return int.from_bytes(b[at : at + size], "little")


def _kind(b: bytes) -> np.dtype | str | None:
    """NumPy's type of a datatype message, 'text' and 'links' for variable strings and lists of references, or None."""
    kind, bits, size = b[0] & 15, _number(b, 1, 3), _number(b, 4, 4)
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    if kind == 9:
        return "text" if bits & 15 == 1 else "links" if b[8] & 15 == 7 else None
    return None


def _shape(b: bytes) -> tuple[int, ...]:
    first = 8 if b[0] == 1 else 4
    return struct.unpack_from(f"<{b[1]}Q", b, first)


def _padded(n: int) -> int:
    return n + -n % 8


class File:
    """The arrays of a file's root group, by name."""

    def __init__(self, path: str):
        self.path, self.opened = path, 0
        with open(path, "rb") as self._f:
            if self._get(0, 8) != SIGNATURE:
                raise ValueError(f"{path} isn't an HDF5 file")
            version = self._get(8, 1)[0]
            if version > 3:
                raise ValueError(f"{path}: superblock {version} isn't known")
            root = _number(self._get({0: 64, 1: 68}.get(version, 36), 8), 0, 8)
            messages = list(self._messages(root))
            self.attributes = self._attributes(messages)
            at = dict(self._links(messages))
            self.variables = {k: v for k, a in at.items() if (v := self._array(k, a)) is not None}
            names = {a: k for k, a in at.items()}
            for v in self.variables.values():
                refs = v.attributes.pop("DIMENSION_LIST", None) or []
                v.attributes.pop("REFERENCE_LIST", None)
                v.dims = tuple(names.get(r, "") for r in refs) if len(refs) == len(v.shape) else (v.name,) if len(v.shape) == 1 else ()
            for v in self.variables.values():
                v.dims = v.dims or self._by_length(v)

    def _get(self, at: int, n: int) -> bytes:
        self._f.seek(at)
        return self._f.read(n)

    def _by_length(self, v: Array) -> tuple[str, ...]:
        """Dimensions of an array that doesn't name them: coordinates of the same lengths."""
        own = {x.shape[0]: x.name for x in self.variables.values() if len(x.shape) == 1}
        return tuple(own.get(n, "") for n in v.shape)

    # object headers
    def _messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        head = self._get(at, 64)
        if head[:4] == b"OHDR":
            flags = head[5]
            first = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            todo, step = [(at + first + width, _number(head, first, width))], 6 if flags & 4 else 4
        else:
            todo, step = [(at + 16, _number(head, 8, 4))], 8
        while todo:
            place, size = todo.pop(0)
            b, k = self._get(place, size), 0
            while k + step <= size:
                kind, n = (_number(b, k, 2), _number(b, k + 2, 2)) if step == 8 else (b[k], _number(b, k + 1, 2))
                body = b[k + step : k + step + n]
                k += step + n
                if kind == 16:
                    more, length = struct.unpack_from("<QQ", body)
                    todo.append((more, length) if step == 8 else (more + 4, length - 8))
                elif kind:
                    yield kind, body

    def _links(self, messages: list[tuple[int, bytes]]) -> Iterator[tuple[str, int]]:
        for kind, b in messages:
            if kind == 6:
                yield from self._link(b)
            elif kind == 17:
                tree, heap = struct.unpack_from("<QQ", b)
                names = _number(self._get(heap + 24, 8), 0, 8)
                yield from self._symbols(tree, names)
            elif kind == 2:
                yield from (x for b in self._dense(b, 8) for x in self._link(b))

    def _link(self, b: bytes) -> Iterator[tuple[str, int]]:
        flags, k = b[1], 2
        link = 0
        if flags & 8:
            link, k = b[k], k + 1
        k += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
        width = 1 << (flags & 3)
        n = _number(b, k, width)
        k += width
        if link == 0:
            yield b[k : k + n].decode(), _number(b, k + n, 8)

    def _symbols(self, tree: int, names: int) -> Iterator[tuple[str, int]]:
        head = self._get(tree, 24)
        used = _number(head, 6, 2)
        children = struct.unpack(f"<{2 * used}Q", self._get(tree + 24, 16 * used))[1::2]
        for child in children:
            if head[5]:
                yield from self._symbols(child, names)
                continue
            for k in range(_number(self._get(child + 6, 2), 0, 2)):
                name, at = struct.unpack("<QQ", self._get(child + 8 + 40 * k, 16))
                yield self._get(names + name, 1024).split(b"\0")[0].decode(), at

    def _dense(self, info: bytes, order: int) -> Iterator[bytes]:
        """What a fractal heap holds, in the order of its index of names. order: bytes of a creation index."""
        k = 2 + (order if info[1] & 1 else 0)
        heap, tree = struct.unpack_from("<QQ", info, k)
        if heap == _NONE:
            return
        h, t = self._get(heap, 142), self._get(tree, 34)
        wide = (_number(h, 128, 2) + 7) // 8
        size, id_size, skip = _number(t, 10, 2), _number(h, 5, 2), 4 if t[5] == 5 else 0
        for record in self._records(_number(t, 16, 8), _number(t, 24, 2), _number(t, 12, 2), size, _number(t, 6, 4)):
            own = record[skip : skip + id_size]
            if own[0] & 48:
                raise ValueError(f"{self.path}: an object that isn't in its heap's blocks")
            offset, length = _number(own, 1, wide), _number(own, 1 + wide, id_size - 1 - wide)
            yield self._get(self._block(h, _number(h, 132, 8), _number(h, 140, 2), offset, wide), length)

    def _records(self, at: int, n: int, depth: int, size: int, node: int) -> Iterator[bytes]:
        b = self._get(at, node)
        if depth > 1:
            raise ValueError(f"{self.path}: an index of names of more than two levels")
        width = (((node - 10) // size).bit_length() + 7) // 8
        for k in range(n + (depth > 0)):
            if depth:
                child = 6 + n * size + k * (8 + width)
                yield from self._records(_number(b, child, 8), _number(b, child + 8, width), 0, size, node)
            if k < n:
                yield b[6 + k * size : 6 + (k + 1) * size]

    def _block(self, h: bytes, root: int, rows: int, offset: int, wide: int) -> int:
        """Address of an offset in a heap."""
        width, start, most = _number(h, 110, 2), _number(h, 112, 8), _number(h, 120, 8)
        if not rows:
            return root + offset
        base, size = 0, start
        for row in range(rows):
            size = start << max(row - 1, 0)
            if offset < base + size * width:
                break
            base += size * width
        column = (offset - base) // size
        child = _number(self._get(root + 13 + wide + 8 * (row * width + column), 8), 0, 8)
        inner = 0 if size <= most else (size // (start * width)).bit_length()
        return self._block(h, child, inner, offset - base - column * size, wide)

    # values
    def _attributes(self, messages: list[tuple[int, bytes]]) -> dict:
        bodies = [b for kind, b in messages if kind == 12] + [x for kind, b in messages if kind == 21 for x in self._dense(b, 2)]
        return dict(map(self._attribute, bodies))

    def _attribute(self, b: bytes) -> tuple[str, object]:
        version, sizes = b[0], struct.unpack_from("<HHH", b, 2)
        at, parts = 8 + (version == 3), []
        for n in sizes:
            parts.append(b[at : at + n])
            at += _padded(n) if version == 1 else n
        name, kind, shape = parts[0].split(b"\0")[0].decode(), _kind(parts[1]), _shape(parts[2])
        count = int(np.prod(shape, dtype=np.int64))
        if isinstance(kind, str):
            found = [self._global(*struct.unpack_from("<IQI", b, at + 16 * k)) for k in range(count)]
            if kind == "links":
                return name, [_number(x, 0, 8) for x in found]
            return name, found[0].decode(errors="replace") if count == 1 else [x.decode(errors="replace") for x in found]
        if kind is None:
            return name, None
        value = np.frombuffer(b, kind, count, at)
        return name, value[0].split(b"\0")[0].decode(errors="replace") if kind.kind == "S" and count == 1 else value

    def _global(self, length: int, heap: int, index: int) -> bytes:
        """A value of variable size; lists have one reference here."""
        size, at = _number(self._get(heap + 8, 8), 0, 8), 16
        b = self._get(heap, size)
        while at + 16 <= size:
            own, n = _number(b, at, 2), _number(b, at + 8, 8)
            if own == index and own:
                return b[at + 16 : at + 16 + n]
            if not own:
                break
            at += 16 + _padded(n)
        return b""

    def _array(self, name: str, at: int) -> Array | None:
        messages = list(self._messages(at))
        by = {kind: b for kind, b in messages if kind in (1, 3, 5, 8, 11)}
        if not {1, 3, 8} <= by.keys() or not isinstance(kind := _kind(by[3]), np.dtype):
            return None
        v = Array(name, _shape(by[1]), kind, self._attributes(messages))
        b = by[8]
        if b[0] != 3:
            raise ValueError(f"{self.path}: {name} has storage layout {b[0]}")
        v.layout = b[1]
        if b[1] == 0:
            v.inline = b[4 : 4 + _number(b, 2, 2)]
        elif b[1] == 1:
            v.address = _number(b, 2, 8)
        else:
            v.address, v.chunks = _number(b, 3, 8), struct.unpack_from(f"<{b[2] - 1}I", b, 11)
        if f := by.get(5):
            size = 4 if f[0] < 3 and f[3] else 2 if f[0] == 3 and f[1] & 32 else 0
            v.fill = f[size + 4 : size + 4 + _number(f, size, 4)] if size else b""
        v.filters = self._filters(by.get(11))
        if odd := set(v.filters) - {1, 2, 3}:
            raise ValueError(f"{self.path}: {name} has filters {odd}")
        return v

    def _filters(self, b: bytes | None) -> list[int]:
        out, k = [], 8 if b and b[0] == 1 else 2
        for _ in range(b[1] if b else 0):
            own = _number(b, k, 2)
            named = b[0] == 1 or own > 255
            name = _number(b, k + 2, 2) if named else 0
            values = _number(b, k + (6 if named else 4), 2)
            k += (8 if named else 6) + (_padded(name) if b[0] == 1 else name) + 4 * (values + (values % 2 if b[0] == 1 else 0))
            out.append(own)
        return out

    def read(self, name: str, box: Box | None = None) -> np.ndarray:
        """The values of an array in a box: from and to (exclusive) for each dimension."""
        v = self.variables[name]
        box = box or [(0, n) for n in v.shape]
        out = np.full([z - a for a, z in box], np.frombuffer(v.fill, v.kind)[0] if len(v.fill) == v.kind.itemsize else 0, v.kind)
        if not out.size:
            return out
        with open(self.path, "rb") as self._f:
            if v.layout == 0:
                return np.frombuffer(v.inline, v.kind).reshape(v.shape)[tuple(slice(*x) for x in box)]
            if v.address == _NONE:
                return out
            if v.layout == 1:
                return self._contiguous(v, box)
            for offset, size, mask, address in self._chunks(v, v.address, box):
                self.opened += 1
                chunk = self._unpacked(v, self._get(address, size), mask)
                common = [(max(a, o), min(z, o + n)) for (a, z), o, n in zip(box, offset, v.chunks, strict=True)]
                out[tuple(slice(a - x, z - x) for (a, z), (x, _) in zip(common, box, strict=True))] = chunk[tuple(slice(a - o, z - o) for (a, z), o in zip(common, offset, strict=True))]
        return out

    def _contiguous(self, v: Array, box: Box) -> np.ndarray:
        """Rows along the first dimension are read, the others cut."""
        if not v.shape:
            return np.frombuffer(self._get(v.address, v.kind.itemsize), v.kind)[0]
        a, z = box[0]
        per = int(np.prod(v.shape[1:], dtype=np.int64)) * v.kind.itemsize
        rows = np.frombuffer(self._get(v.address + a * per, (z - a) * per), v.kind).reshape(z - a, *v.shape[1:])
        return rows[(slice(None), *[slice(*x) for x in box[1:]])]

    def _chunks(self, v: Array, at: int, box: Box) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Offset, stored size, filter mask and address of the chunks that meet a box."""
        head = self._get(at, 24)
        used, rank = _number(head, 6, 2), len(v.shape)
        step = 8 + 8 * (rank + 1) + 8
        b = self._get(at + 24, used * step + step - 8)
        for k in range(used):
            size, mask, *offset = struct.unpack_from(f"<II{rank}Q", b, k * step)
            child = _number(b, (k + 1) * step - 8, 8)
            if head[5]:  # keys are in order of the first dimension
                last = _number(b, (k + 1) * step + 8, 8)
                if offset[0] < box[0][1] and last + v.chunks[0] > box[0][0]:
                    yield from self._chunks(v, child, box)
            elif all(o < z and o + n > a for o, n, (a, z) in zip(offset, v.chunks, box, strict=True)):
                yield tuple(offset), size, mask, child

    def _unpacked(self, v: Array, b: bytes, mask: int) -> np.ndarray:
        for k in reversed(range(len(v.filters))):
            if mask >> k & 1:
                continue
            if v.filters[k] == 3:
                b = b[:-4]
            elif v.filters[k] == 1:
                b = zlib.decompress(b)
            else:
                b = np.frombuffer(b, np.uint8).reshape(v.kind.itemsize, -1).T.tobytes()
        return np.frombuffer(b, v.kind).reshape(v.chunks)
