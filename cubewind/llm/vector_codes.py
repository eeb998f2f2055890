"""Compression of vectors to codes: each of some consecutive parts is the number of an entry in the codebook of its position.

Tasks turn batches of rows into NumPy blocks with a row per component. A round is a treeAggregate over the RDD of blocks:
distances of a block accumulate component by component, np.add.at adds its parts to tensors of sums and counts (positions x
entries, int64), and tensors merge through a reduction tree, so the driver gets a few of them, 40 KB each, at any input size.

Cases: vectors that are null, of another length or with null or non-finite components are left out. Rows are told apart, so
repeated vec_ids are coded each on their own; a row without vec_id is coded, but isn't an entry at the start, and of repeated
vec_ids the least components come first. With fewer rows than entries there are fewer entries, without rows the result is empty.
Integers saturate at 2^27 in size; a sum of errors beyond a long is NULL. Rows without a label are one group, which may be any
share of all rows: sums are formed before the shuffle, and those of large groups are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.centroids import LARGEST, integers, matrix, whole
from cubewind.llm.tables import discard, in_batches, keep, with_groups

PARTS, ENTRIES, ROUNDS, SCALE, DIMENSIONS = 16, 64, 2, 256, 64
Tensors = tuple[np.ndarray, np.ndarray]


def blocks(table: DataFrame, dimensions: int) -> RDD:
    """Arrays of dimensions x rows, one per batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([matrix(b.column("q"), dimensions).T.astype(np.int32).tobytes()], pa.binary())], names=["block"])

    return in_batches(table.select("q"), run, "block binary").rdd.map(lambda r: np.frombuffer(r["block"], np.int32).reshape(dimensions, -1))


def encode(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, positions x rows; of equal distances the lower code. books: positions x entries x width."""
    positions, entries, width = books.shape
    codes, error = np.zeros((positions, block.shape[1]), np.int64), np.zeros((positions, block.shape[1]), np.int64)
    for p in range(positions):
        far = np.zeros((entries, block.shape[1]), np.int64)
        for d in range(width):
            apart = block[p * width + d].astype(np.int64) - books[p, :, d, None]
            far += apart * apart
        codes[p] = far.argmin(0)
        error[p] = np.take_along_axis(far, codes[p][None], 0)[0]
    return codes, error


def _add(books: np.ndarray):
    def add(total: Tensors, block: np.ndarray) -> Tensors:
        sums, counts = total
        width = books.shape[2]
        codes, _ = encode(block, books)
        for p, own in enumerate(codes):
            np.add.at(sums[p], own, block[p * width : (p + 1) * width].T)
            np.add.at(counts[p], own, 1)
        return total

    return add


def _merge(a: Tensors, b: Tensors) -> Tensors:
    return a[0] + b[0], a[1] + b[1]


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = encode(matrix(b.column("q"), books.shape[0] * books.shape[2]).T, books)
            text = codes.T.astype(np.uint8).tobytes().hex()
            n = 2 * len(books)
            yield pa.record_batch([b.column("vec_id"), pa.array([text[k : k + n] for k in range(0, len(text), n)], pa.string()), pa.array(error.sum(0)), b.column("label"), b.column("labelled")], names=["vec_id", "code", "error", "label", "labelled"])

    return run


_CODED = "vec_id long, code string, error long, label string, labelled boolean"


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """vectors: vec_id, embedding, label. Returns a written table of vec_id, code, error, label (a string) and whether there is
    one, and the final codebooks. entries: 256 at most, two hex digits."""
    label = F.col("label").cast("string")
    rows = vectors.where(whole(F.col("embedding"), dimensions)).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("q"), F.coalesce(label, F.lit("")).alias("label"), label.isNotNull().alias("labelled"))
    table = keep(rows, "parts")
    start = table.where("vec_id IS NOT NULL").orderBy("vec_id", "q").limit(entries).select("q").collect()  # `entries` rows
    books = np.array([r["q"] for r in start], np.int64).reshape(-1, parts, dimensions // parts).transpose(1, 0, 2).copy()
    if not len(start):
        discard(table)
        return table.sparkSession.createDataFrame([], _CODED), books
    for _ in range(rounds):
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = blocks(table, dimensions).treeAggregate(zero, _add(books), _merge)
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    found = keep(in_batches(table, _coded(books), _CODED), "codes")
    discard(table)
    return found, books


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    key = ["label", "labelled"]
    groups = coded.groupBy(*key).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return with_groups(coded, groups, key, "n").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    width = DIMENSIONS // PARTS
    far = " + ".join(f"(p.q[{d}] - e.q[{d}]) * (p.q[{d}] - e.q[{d}])" for d in range(1, width + 1))
    means = ", ".join(f"CAST((sum(q[{d}]) - ((sum(q[{d}]) % count(*) + count(*)) % count(*))) // count(*) AS BIGINT)" for d in range(1, width + 1))
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(greatest(least({SCALE} * CAST(x AS DOUBLE), {LARGEST}), -{LARGEST})) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, list_slice(q, k * {width} + 1, k * {width} + {width}) AS q FROM v, (SELECT unnest(range({PARTS})) AS k)),
s AS (SELECT r, row_number() OVER (ORDER BY vec_id, q) - 1 AS e FROM v WHERE vec_id IS NOT NULL QUALIFY e < {ENTRIES}),
e0 AS MATERIALIZED (SELECT k, e, q FROM p JOIN s USING (r)),
"""
    for k in range(ROUNDS + 1):
        out += f"a{k} AS MATERIALIZED (SELECT p.r, p.k, min({{'d': {far}, 'e': e}}) AS b FROM p JOIN e{k} AS e ON p.k = e.k GROUP BY 1, 2),\n"
        if k < ROUNDS:
            out += f"""m{k} AS (SELECT k, b.e AS e, [{means}] AS q FROM a{k} JOIN p USING (r, k) GROUP BY 1, 2),
e{k + 1} AS MATERIALIZED (SELECT k, e, coalesce(m{k}.q, e{k}.q) AS q FROM e{k} LEFT JOIN m{k} USING (k, e)),
"""
    return out + f"""z AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY k) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY k, e)) AS h FROM e{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM z JOIN v USING (r), h"""


SQL = _sql()
