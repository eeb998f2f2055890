"""Small HDF5 files in the two layouts that NetCDF-4 writes: symbol tables with version 1 headers, or links and dense attributes
with version 2 headers."""

import itertools
import struct
import zlib

import numpy as np

NONE = 2**64 - 1


def pad(b):
    return b + b"\0" * (-len(b) % 8)


def kind_of(x):
    if isinstance(x, str):
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, len(x))
    if x == "refs":
        return struct.pack("<BBBBI", 0x19, 0, 0, 0, 16)
    if x.kind == "f":
        exp = (52, 11, 0, 52, 1023) if x.itemsize == 8 else (23, 8, 0, 23, 127)
        return struct.pack("<BBBBI", 0x11, 0x20 | (x.byteorder == ">"), x.itemsize * 8 - 1, 0, x.itemsize) + struct.pack("<HHBBBBI", 0, x.itemsize * 8, *exp)
    return struct.pack("<BBBBI", 0x10, (8 if x.kind == "i" else 0) | (x.byteorder == ">"), 0, 0, x.itemsize) + struct.pack("<HH", 0, x.itemsize * 8)


def space(shape):
    return struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) + struct.pack(f"<{len(shape)}Q", *shape)


class Builder:
    def __init__(self, modern=False):
        self.modern, self.b, self.links = modern, bytearray(96), {}

    def put(self, data):
        self.b += b"\0" * (-len(self.b) % 8)
        at = len(self.b)
        self.b += data
        return at

    def attribute(self, name, value):
        label = name.encode() + b"\0"
        if isinstance(value, list):  # references to one array each
            heap, rows = b"", b""
            for k, v in enumerate(value, 1):
                heap += struct.pack("<HHIQQ", k, 1, 0, 8, self.links[v])
            at = self.put(b"GCOL" + struct.pack("<BBBBQ", 1, 0, 0, 0, 16 + len(heap) + 16) + heap + bytes(16))
            for k in range(len(value)):
                rows += struct.pack("<IQI", 1, at, k + 1)
            kind, shape, raw = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8), space((len(value),)), rows
        elif isinstance(value, str):
            kind, shape, raw = kind_of(value), space(()), value.encode()
        else:
            x = np.atleast_1d(value)
            kind, shape, raw = kind_of(x.dtype), space(x.shape), x.tobytes()
        if self.modern:
            return struct.pack("<BBHHHB", 3, 0, len(label), len(kind), len(shape), 0) + label + kind + shape + raw
        return struct.pack("<BBHHH", 1, 0, len(label), len(kind), len(shape)) + pad(label) + pad(kind) + pad(shape) + raw

    def header(self, messages):
        """The last two messages go to a continuation block."""
        if not self.modern:
            pack = lambda ms: b"".join(struct.pack("<HHBBBB", k, len(pad(m)), 0, 0, 0, 0) + pad(m) for k, m in ms)
            more = pack(messages[-2:])
            own = pack([*messages[:-2], (16, struct.pack("<QQ", self.put(more), len(more)))])
            return self.put(struct.pack("<BBHII", 1, 0, len(messages) + 1, 1, len(own)) + bytes(4) + own)
        pack = lambda ms: b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in ms)
        more = b"OCHK" + pack(messages[-2:]) + bytes(4)
        own = pack([*messages[:-2], (16, struct.pack("<QQ", self.put(more), len(more)))])
        return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(own)) + own + bytes(4))

    def dense(self, attributes):
        """A fractal heap with one block, and its index of names."""
        block, ids = b"FHDB" + struct.pack("<BQ", 0, 0) + bytes(5), []
        for a in attributes:
            ids.append(bytes([0]) + len(block).to_bytes(5, "little") + len(a).to_bytes(2, "little"))
            block += a
        size = 1 << max(len(block) - 1, 511).bit_length()
        root = self.put(block + bytes(size - len(block)))
        heap = self.put(
            b"FRHP" + struct.pack("<BHHBI", 0, 8, 0, 0, 4096) + struct.pack("<QQQQ", 0, NONE, 0, NONE) + struct.pack("<QQQQQQQQ", size, size, 0, len(ids), 0, 0, 0, 0)
            + struct.pack("<HQQHHQH", 4, size, max(size, 65536), 40, 0, root, 0) + bytes(4)
        )
        leaf = self.put(pad(b"BTLF" + bytes([0, 8]) + b"".join(x + bytes([0]) + struct.pack("<II", k, k) for k, x in enumerate(ids))) + bytes(512))
        tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 8, 512, 17, 0, 100, 40, leaf, len(ids), len(ids)) + bytes(4))
        return struct.pack("<BBQQ", 0, 0, heap, tree)

    def array(self, name, x, attributes=None, chunks=None, deflate=True, skip=(), fill=None, fanout=3):
        """skip: chunks that were never written."""
        attributes = attributes or {}
        messages = [(1, space(x.shape)), (3, kind_of(x.dtype))]
        if chunks is None:
            messages.append((8, struct.pack("<BBQQ", 3, 1, self.put(x.tobytes()), x.nbytes)))
        else:
            entries = []
            for offset in itertools.product(*[range(0, n, c) for n, c in zip(x.shape, chunks, strict=True)]):
                if offset in skip:
                    continue
                part = np.zeros(chunks, x.dtype)
                own = x[tuple(slice(o, o + c) for o, c in zip(offset, chunks, strict=True))]
                part[tuple(slice(0, n) for n in own.shape)] = own
                raw = part.tobytes()
                if deflate:
                    raw = zlib.compress(np.frombuffer(raw, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
                entries.append((offset, len(raw), self.put(raw)))
            key = lambda o, n: struct.pack(f"<II{len(o)}QQ", n, 0, *o, 0)
            end = (key(x.shape, 0),)
            node = lambda level, rows, after: self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(rows), NONE, NONE) + b"".join(key(o, n) + struct.pack("<Q", a) for o, n, a in rows) + after)
            groups = [entries[k : k + fanout] for k in range(0, len(entries), fanout)]
            leaves = [(g[0][0], g[0][1], node(0, g, key(groups[n + 1][0][0], 0) if n + 1 < len(groups) else end[0])) for n, g in enumerate(groups)]
            root = leaves[0][2] if len(leaves) == 1 else node(1, leaves, end[0])
            messages.append((8, struct.pack("<BBB", 3, 2, len(chunks) + 1) + struct.pack("<Q", root) + struct.pack(f"<{len(chunks) + 1}I", *chunks, x.dtype.itemsize)))
            if deflate:
                if self.modern:
                    messages.append((11, struct.pack("<BB", 2, 2) + struct.pack("<HHHI", 2, 0, 1, x.dtype.itemsize) + struct.pack("<HHHI", 1, 0, 1, 4)))
                else:
                    messages.append((11, struct.pack("<BB6x", 1, 2) + struct.pack("<HHHHII", 2, 0, 0, 1, x.dtype.itemsize, 0) + struct.pack("<HHHHII", 1, 0, 0, 1, 4, 0)))
        if fill is not None:
            raw = np.asarray(fill, x.dtype).tobytes()
            messages.append((5, (struct.pack("<BB", 3, 32) if self.modern else struct.pack("<BBBB", 2, 2, 0, 1)) + struct.pack("<I", len(raw)) + raw))
        packed = [self.attribute(k, v) for k, v in attributes.items()]
        if self.modern and len(packed) > 3:
            messages.append((21, self.dense(packed)))
        else:
            messages += [(12, m) for m in packed]
        self.links[name] = self.header(messages)

    def write(self, path, attributes=None):
        packed = [(12, self.attribute(k, v)) for k, v in (attributes or {}).items()]
        if self.modern:
            links = [(6, struct.pack("<BBB", 1, 0, len(k)) + k.encode() + struct.pack("<Q", a)) for k, a in self.links.items()]
            root = self.header([(2, struct.pack("<BBQQ", 0, 0, NONE, NONE)), *links, *packed])
            top = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, NONE, len(self.b), root)
        else:
            names, heap = sorted(self.links), b"\0" * 8
            places = []
            for k in names:
                places.append(len(heap))
                heap += pad(k.encode() + b"\0")
            data = self.put(heap)
            local = self.put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(heap), NONE, data))
            symbols = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(names)) + b"".join(struct.pack("<QQII16x", p, self.links[k], 0, 0) for k, p in zip(names, places, strict=True)))
            tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, symbols, places[-1]))
            root = self.header([(17, struct.pack("<QQ", tree, local)), *packed, (0, bytes(8)), (0, bytes(8))])
            top = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.b), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.b[: len(top)] = top
        with open(path, "wb") as f:
            f.write(self.b)
