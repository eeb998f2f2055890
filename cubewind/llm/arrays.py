"""Sorted hash arrays in the folder that driver and executors share, which workers map."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

import numpy as np


_MARK = "_made"
_SEEN: set[str] = set()


class Store:
    """Arrays under names in one folder, which the driver makes. A mounted folder is mapped; one that isn't is read into memory.
    A process that can't see the folder gets an error, not empty arrays."""

    def __init__(self, uri: str):
        self.uri = uri
        parts = urlsplit(uri)
        self.mounted = parts.scheme in ("", "file")
        self.path = unquote(parts.path) if parts.scheme == "file" else uri

    def made(self) -> Store:
        """Called by the driver before tasks put or get anything."""
        self.put(_MARK, np.zeros(1, np.uint8))
        return self

    def _visible(self) -> None:
        if self.uri in _SEEN:
            return
        if self.mounted:
            there = os.path.exists(f"{self.path}/{_MARK}")
        else:
            from pyarrow import fs

            files, base = fs.FileSystem.from_uri(self.path)
            there = files.get_file_info(f"{base}/{_MARK}").type != fs.FileType.NotFound
        if not there:
            raise FileNotFoundError(f"{self.uri} can't be seen here; spark.checkpoint.dir must be a folder that all share")
        _SEEN.add(self.uri)

    def put(self, name: str, array: np.ndarray) -> None:
        """A task that runs again writes the same array again; a file is there whole or not at all."""
        array = np.ascontiguousarray(array)
        if self.mounted:
            os.makedirs(self.path, exist_ok=True)
            with open(own := f"{self.path}/.{uuid.uuid4().hex}", "wb") as f:
                f.write(memoryview(array).cast("B") if array.size else b"")
            os.replace(own, f"{self.path}/{name}")
        else:
            from pyarrow import fs

            files, base = fs.FileSystem.from_uri(self.path)
            files.create_dir(base, recursive=True)
            with files.open_output_stream(f"{base}/{name}") as f:
                f.write(array.tobytes())

    def get(self, name: str, kind: str) -> np.ndarray:
        """The array; an empty one if nothing was put under the name."""
        self._visible()
        if self.mounted:
            path = f"{self.path}/{name}"
            return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
            return np.zeros(0, kind)
        with files.open_input_stream(f"{base}/{name}") as f:
            return np.frombuffer(f.read(), kind)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where the rows of sorted keys differ from the row before them."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(fresh)
