"""Whole Arrow columns of text as numpy word tables: one pass over the UTF-8 bytes, no loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as numpy arrays at once; one longer document is a piece of its own.
PIECE_BYTES = 250_000

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _MULT, np.uint64)]))


def powers(n: int) -> np.ndarray:
    size = 1 << 10
    while size < n:
        size <<= 1
    return _powers(size)


class WordClass:
    """Which bytes are in words, and a random value of each, the same for A-Z and a-z."""

    def __init__(self, breaks: bytes, fold: bool = True, between: tuple[bytes, bytes] | None = None):
        """between: words also end between a byte of the first kind and one of the second, either way."""
        self.inside = np.ones(256, bool)
        self.inside[list(breaks)] = False
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.value[~self.inside] = 0
        self.side = np.zeros(256, np.int8)
        for k, own in enumerate(between or (), 1):
            self.side[list(own)] = k
        self.split = between is not None


#: Words between white space: [^\x20\x09-\x0D]+
SPACED = WordClass(b"\x20\x09\x0a\x0b\x0c\x0d")
SPACED_EXACT = WordClass(b"\x20\x09\x0a\x0b\x0c\x0d", fold=False)
#: The same, cut between an ASCII letter and punctuation other than apostrophes and the signs in special tokens
PUNCTUATED = WordClass(b"\x20\x09\x0a\x0b\x0c\x0d", between=(bytes([*range(65, 91), *range(97, 123)]), b".,;:!?*%$#&()"))
#: Letters, digits and all that isn't ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = WordClass(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


@dataclass
class Words:
    """Words of some documents: row numbers in the batch, first word of each row (one more at the end), byte spans, hashes."""

    rows: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    def doc(self) -> np.ndarray:
        """The place in rows of each word."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if offsets is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def scan(b: np.ndarray, marks: np.ndarray, kind: WordClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of b; marks: offsets at which a document begins."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = kind.inside[b]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    if kind.split:
        side = kind.side[b]
        begin[1:] |= side[:-1] + side[1:] == 3
    at = marks[marks < n]
    begin[at] = inside[at]
    start = np.flatnonzero(begin)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    last = inside
    last[:-1] &= ~inside[1:] | begin[1:]
    end = np.flatnonzero(last) + 1
    head = np.zeros(n, np.int64)
    head[start] = start
    np.maximum.accumulate(head, out=head)
    np.subtract(np.arange(n), head, out=head)
    head[: start[0]] = 0
    gaps = int((end - start).max())
    np.minimum(head, gaps, out=head)
    value = powers(gaps + 1)[head]
    value *= kind.value[b]
    h = np.add.reduceat(value, start)
    return start, end, mix(h + (end - start).astype(np.uint64))


def pieces(col: pa.Array, kind: WordClass, limit: int = PIECE_BYTES) -> Iterator[Words]:
    """The words of a string column, in pieces of at most limit bytes or one row."""
    offsets, data = buffers(col)
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        o = offsets[a : z + 1] - offsets[a]
        b = data[offsets[a] : offsets[z]]
        start, end, h = scan(b, o[:-1], kind)
        yield Words(np.arange(a, z), np.searchsorted(start, o).astype(np.int64), start, end, h, b)
        a = z


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a row, the place in rows and the first word of each."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = w.doc()
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    h = w.hash[at].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(3) + w.hash[at + k])
    return h, doc[at], at


def exact(w: Words, k: int) -> bytes:
    return w.data[w.start[k] : w.end[k]].tobytes()
