"""Benchmark decontamination by Wu-Manber search over words.

A symbol is a word (lower-cased A-Z; letters, digits and all that isn't ASCII). The test strings are all runs of `width`
words of the items; an item of fewer words is one test string. A shift table over blocks of two words skips positions at
which no test string can end, buckets by suffix hash select test strings, and a comparison of the words confirms them.

The tables are built once, in Spark: test strings are dealt to parts by their suffix hash and written as sorted arrays to the
shared folder, shifts are minima per block. Workers map them, and documents are read once, however large the benchmark is.

Nulls and texts without words: no words and no hits. Repeated items count once by item_id; a null item_id is an empty one. An
empty benchmark finds nothing. Repeated doc_ids, null too, are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.arrays import Store, part_of, runs
from cubewind.llm.tables import in_batches, keep, place
from cubewind.llm.textscan import ALNUM, Words, mix, pieces

WIDTH = 10
#: About how many test strings and how many entries of a shift table one file holds.
PART = 200_000
SLICE = 1 << 22
_LANE = 256


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + b)


def _suffix(symbols: np.ndarray) -> np.ndarray:
    return _block(symbols[:, -2], symbols[:, -1]) if symbols.shape[1] > 1 else mix(symbols[:, -1])


def _said(w: Words, a: int, z: int) -> bytes:
    """The words from a to z as they are compared."""
    return b" ".join(w.data[x:y].tobytes() for x, y in zip(w.start[a:z].tolist(), w.end[a:z].tolist(), strict=True)).lower()


def _strings(width: int):
    """Test strings of items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for w in pieces(batch.column("text"), ALNUM):
                size = np.diff(w.first)
                doc = w.doc()
                for n in np.unique(np.minimum(size[size > 0], width)).tolist():
                    own = size >= n if n == width else size == n
                    at = np.flatnonzero(own[doc] & (np.arange(len(doc)) + n <= w.first[1:][doc]))
                    symbols = w.hash[at[:, None] + np.arange(n)]
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(at), n, np.int32)),
                            pa.array(_suffix(symbols).view(np.int64)),
                            pa.array([x.tobytes() for x in symbols], pa.binary()),
                            pa.array([_said(w, a, a + n) for a in at.tolist()], pa.binary()),
                            ids.take(pa.array(w.rows[doc[at]])),
                        ],
                        names=["n", "suffix", "symbols", "words", "item_id"],
                    )

    return run


def _shifts(slots: int):
    """(n, slot, shift) of all blocks of test strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("n").to_numpy()
            symbols = batch.column("symbols").to_pylist()
            for n in np.unique(widths).tolist():
                own = np.frombuffer(b"".join(symbols[k] for k in np.flatnonzero(widths == n).tolist()), np.uint64).reshape(-1, n)
                block = min(2, n)
                for j in range(block, n + 1):
                    slot = np.unique(_suffix(own[:, :j]) & np.uint64(slots - 1)).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(slot), x, t)) if isinstance(x, int) else pa.array(x) for x, t in ((n, np.int32), (slot, None), (n - j, np.int32))], names=["n", "slot", "shift"])

    return run


def _wrote(*counts: int) -> pa.Table:
    return pa.table([pa.array([c], pa.int64()) for c in counts], names=["n", "part", "size"])


def _write_strings(store: Store):
    def run(table: pa.Table) -> pa.Table:
        n, part = table.column("n")[0].as_py(), table.column("part")[0].as_py()
        suffix = table.column("suffix").to_numpy().view(np.uint64)
        words, items = (table.column(c).combine_chunks().dictionary_encode() for c in ("words", "item_id"))
        word, item = words.indices.to_numpy(), items.indices.to_numpy()
        order = np.lexsort((item, word, suffix))
        order = order[runs(word[order], item[order])]
        first = runs(word[order])
        symbols = np.frombuffer(b"".join(table.column("symbols").take(pa.array(order[first])).to_pylist()), np.uint64)
        name = f"{n}-{part}"
        store.put(f"suffix-{name}", suffix[order[first]])
        store.put(f"symbols-{name}", symbols)
        store.put(f"items-{name}", np.append(first, len(order)))
        for what, values in (("words", words.dictionary.take(pa.array(word[order[first]]))), ("ids", items.dictionary.take(pa.array(item[order])).cast(pa.binary()))):
            texts = values.to_pylist()
            store.put(f"{what}-{name}", np.frombuffer(b"".join(texts), np.uint8))
            store.put(f"{what}-at-{name}", np.cumsum([0, *map(len, texts)]))
        return _wrote(n, part, len(first))

    return run


def _write_shifts(store: Store, size: int):
    def run(table: pa.Table) -> pa.Table:
        n, part = table.column("n")[0].as_py(), table.column("part")[0].as_py()
        shift = np.full(size, max(n - 1, 1), np.uint8)
        shift[table.column("slot").to_numpy() % size] = table.column("shift").to_numpy()
        store.put(f"shift-{n}-{part}", shift)
        return _wrote(n, part, len(table))

    return run


class ShiftTable:
    """Test strings of n words, in arrays of the store."""

    def __init__(self, store: Store, n: int, parts: int, slots: int, size: int):
        self.store, self.n, self.parts, self.slots, self.size = store, n, parts, slots, size
        self.maps: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}

    def array(self, name: str, kind: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = self.store.get(name, kind)
        return self.maps[name]

    def shift(self, key: np.ndarray) -> np.ndarray:
        slot = (key & np.uint64(self.slots - 1)).astype(np.int64)
        out = np.full(len(key), max(self.n - 1, 1), np.int64)
        part = slot // self.size
        for p in np.unique(part).tolist():
            own = part == p
            if len(there := self.array(f"shift-{self.n}-{p}", "u1")):
                out[own] = there[slot[own] % self.size]
        return out

    def matches(self, h: np.ndarray, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, ends, numbers of test strings) of what ends at the places `at`, where the suffix hash is key."""
        part = part_of(key, self.parts)
        for p in np.unique(part).tolist():
            own = part == p
            suffix = self.array(f"suffix-{self.n}-{p}", "<u8")
            lo, hi = np.searchsorted(suffix, key[own], "left"), np.searchsorted(suffix, key[own], "right")
            if not (count := hi - lo).any():
                continue
            symbols = self.array(f"symbols-{self.n}-{p}", "<u8").reshape(-1, self.n)
            pos = np.repeat(at[own], count)
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
            for k in range(self.n):
                same = h[pos - k] == symbols[which, self.n - 1 - k]
                pos, which = pos[same], which[same]
            if len(pos):
                yield p, pos, which

    def find(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of all occurrences in h; many lanes of h are searched at once."""
        at = np.arange(self.n - 1, len(h), _LANE)
        stop = np.minimum(at + _LANE, len(h))
        while len(at):
            key = _block(h[at - 1], h[at]) if self.n > 1 else mix(h[at])
            step = self.shift(key)
            hit = step == 0
            yield from self.matches(h, at[hit], key[hit])
            step[hit] = 1
            at = at + step
            on = at < stop
            at, stop = at[on], stop[on]

    def words(self, part: int, k: int) -> bytes:
        at = self.array(f"words-at-{self.n}-{part}", "<i8")
        return self.array(f"words-{self.n}-{part}", "u1")[at[k] : at[k + 1]].tobytes()

    def items(self, part: int, k: int) -> list[str]:
        a, z = self.array(f"items-{self.n}-{part}", "<i8")[k : k + 2].tolist()
        to = self.array(f"ids-at-{self.n}-{part}", "<i8")[a : z + 1].tolist()
        ids = self.array(f"ids-{self.n}-{part}", "u1")
        return [ids[x:y].tobytes().decode() for x, y in zip(to[:-1], to[1:], strict=True)]


class Patterns:
    """All test strings of a benchmark."""

    def __init__(self, tables: list[ShiftTable]):
        self.tables = tables

    def search(self, w: Words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """By place in w.rows: spans of words that are hit, merged, and the items."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        doc = w.doc()
        seen: dict[tuple[bytes, int, int, int], list[str]] = {}
        for table in self.tables:
            for part, ends, which in table.find(w.hash):
                begin = ends - table.n + 1
                inside = doc[begin] == doc[ends]
                for a, z, s in zip(begin[inside].tolist(), ends[inside].tolist(), which[inside].tolist(), strict=True):
                    said = _said(w, a, z + 1)
                    if (own := seen.get(key := (said, table.n, part, s))) is None:
                        own = seen[key] = table.items(part, s) if table.words(part, s) == said else []
                    if own:
                        d = int(doc[a])
                        spans.setdefault(d, []).append((a - int(w.first[d]), z + 1 - int(w.first[d])))
                        items.setdefault(d, set()).update(own)
        for d, found in spans.items():
            merged: list[tuple[int, int]] = []
            for a, z in sorted(found):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(z, merged[-1][1]))
                else:
                    merged.append((a, z))
            spans[d] = merged
        return spans, items


def patterns(benchmark: DataFrame, width: int = WIDTH, part: int = PART) -> Patterns:
    """Build the tables of a benchmark (item_id, text) in the shared folder."""
    spark = benchmark.sparkSession
    store = Store(place(spark, "benchmark")).made()
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    strings = keep(in_batches(items, _strings(width), "n int, suffix long, symbols binary, words binary, item_id string"), "strings")
    total = strings.count()
    parts = max(1, -(-total // part))
    slots = 1 << min(max((16 * total).bit_length(), 16), 30)
    size = min(SLICE, slots)
    # parts are ranges of the upper half of the hash, as in part_of
    dealt = strings.withColumn("part", F.shiftrightunsigned(F.shiftrightunsigned("suffix", 32) * parts, 32))
    done = dealt.groupBy("n", "part").applyInArrow(_write_strings(store), "n long, part long, size long")
    widths = sorted(r["n"] for r in done.groupBy("n").agg(F.sum("size")).collect())  # width rows at most
    shifts = in_batches(strings.select("n", "symbols"), _shifts(slots), "n int, slot long, shift int").groupBy("n", "slot").agg(F.min("shift").alias("shift"))
    shifts.withColumn("part", F.floor(F.col("slot") / size)).groupBy("n", "part").applyInArrow(_write_shifts(store, size), "n long, part long, size long").agg(F.sum("size")).collect()
    return Patterns([ShiftTable(store, n, parts, slots, size) for n in widths])


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "doc_id long, n_words long, spans array<struct<a: long, z: long>>, items array<string>"


def _covered(spans: Column) -> Column:
    """How many words the spans hold; spans are merged after sorting."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda s, x: F.struct((s["n"] + F.greatest(x["z"] - F.greatest(x["a"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["z"]).alias("to")),
        lambda s: s["n"],
    )


def find_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part: int = PART) -> DataFrame:
    """Per row: doc_id, n_words, spans of words that occur in the benchmark, items (as strings) with an occurring window."""
    known = patterns(benchmark, width, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in pieces(batch.column("text"), ALNUM):
                spans, found = known.search(w)
                n = range(len(w.rows))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(int(w.rows[0]), len(w.rows)),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array([[{"a": a, "z": z} for a, z in spans.get(k, ())] for k in n], _SPANS),
                        pa.array([sorted(found.get(k, ())) for k in n], pa.list_(pa.string())),
                    ],
                    schema=_FOUND,
                )

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _FOUND_DDL)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = find_items(docs, benchmark, width)
    return found.select(
        "doc_id",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        "spans",
        "items",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows in which no benchmark window occurs, whatever their doc_id."""
    known = patterns(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean: list[bool] = []
            for w in pieces(batch.column("text"), ALNUM):
                spans, _ = known.search(w)
                clean += [k not in spans for k in range(len(w.rows))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return in_batches(docs, run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
runs AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM a, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, runs.n, item_id FROM runs JOIN windows ON runs.s = windows.s AND runs.n = windows.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM a LEFT JOIN words ON a.doc_id = words.doc_id LEFT JOIN items ON a.doc_id = items.doc_id
"""
