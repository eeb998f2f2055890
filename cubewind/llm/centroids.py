"""Centroid clustering of integer vectors, screened by block norms.

A vector is cut into segments whose Euclidean norms are computed once and stored with it. By the Cauchy-Schwarz inequality the
squared distance to a centroid is at least the squared distance of the two short vectors of norms, which one small matrix
product gives for all centroids. The centroid of the least bound is measured first; of the others only those whose bound
doesn't exceed the best distance get an exact integer distance, so results are those of a plain search.

A round reads the table once; tasks return a row of sums per centroid, Spark adds them up, and the driver holds k centroids.

Cases: vectors that are null, of another length or with null or non-finite components are left out. Rows are told apart, so
repeated vec_ids are clustered each on their own; a row without vec_id is clustered, but doesn't start a centroid. Of repeated
vec_ids the least components start first. With fewer than k rows there are fewer centroids, without rows the result is empty.
Integers saturate at 2^27 in size, so that a squared distance is a long; an inertia beyond a long is NULL. Other columns of the
table aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.tables import discard, in_batches, keep

CENTROIDS, ROUNDS, SCALE, DIMENSIONS = 16, 3, 64, 64
SEGMENTS = 8
LARGEST = 2**27


def whole(vector: Column, dimensions: int) -> Column:
    """Whether a vector has so many components, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, between -LARGEST and LARGEST."""
    bound = lambda x: F.greatest(F.least(x, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return F.transform(vector, lambda x: F.floor(bound(x.cast("double") * scale)).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    return np.sqrt(np.stack([(s.astype(float) ** 2).sum(1) for s in np.array_split(x, segments, axis=1)], axis=1))


def nearest(x: np.ndarray, short: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each row, ties to the smaller number, and how many exact
    distances that took. short: norms(x)."""
    own = norms(centroids, short.shape[1])
    size = (short**2).sum(1)[:, None] + (own**2).sum(1)[None]
    least = size - 2 * short @ own.T - (1e-9 * size + 1)  # less than what rounding may have added
    first = least.argmin(1)
    best, at, taken = ((x - centroids[first]) ** 2).sum(1), first.copy(), len(x)
    for c in range(len(centroids)):
        k = np.flatnonzero((least[:, c] <= best) & (first != c))
        d = ((x[k] - centroids[c]) ** 2).sum(1)
        nearer = (d < best[k]) | ((d == best[k]) & (c < at[k]))
        best[k[nearer]], at[k[nearer]] = d[nearer], c
        taken += len(k)
    return at, best, taken


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("q"), centroids.shape[1]).astype(np.int64)
            at, far, _ = nearest(x, matrix(b.column("norms"), SEGMENTS), centroids)
            yield pa.record_batch([b.column("vec_id"), pa.array(at, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def _summed(centroids: np.ndarray):
    """A row per centroid and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = matrix(b.column("q"), centroids.shape[1]).astype(np.int64)
            at, _, _ = nearest(x, matrix(b.column("norms"), SEGMENTS), centroids)
            counts += np.bincount(at, minlength=k)
            for c in np.unique(at):
                sums[c] += x[at == c].sum(0)
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vectors: vec_id, embedding. Returns a written table of vec_id, cluster and squared distance, and the final centroids."""
    spark = vectors.sparkSession
    rows = vectors.where(whole(F.col("embedding"), dimensions)).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("q"))

    def with_norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = norms(matrix(b.column("q"), dimensions))
            yield pa.record_batch([b.column("vec_id"), b.column("q"), pa.array(short.tolist(), pa.list_(pa.float64()))], names=["vec_id", "q", "norms"])

    table = keep(in_batches(rows, with_norms, "vec_id long, q array<int>, norms array<double>"), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = table.where("vec_id IS NOT NULL").orderBy(digest, "q").limit(k).select("q").collect()  # k rows
    centroids = np.array([r["q"] for r in start], np.int64).reshape(-1, dimensions)
    if not len(start):
        discard(table)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        parts = in_batches(table.select("q", "norms"), _summed(centroids), "cluster int, n long, sums array<long>")
        total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(dimensions)]).alias("sums"))
        for r in total.collect():  # k rows
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    found = keep(in_batches(table, _assigned(centroids), "vec_id long, cluster int, distance long"), "clustered")
    discard(table)
    return found, centroids


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    fits = lambda n: n if n < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each = [(c, fits(d), fits(sum(sums.values())), digest[c]) for c, d in sums.items()]
    table = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(least({SCALE} * CAST(x AS DOUBLE), {LARGEST}), -{LARGEST})) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS INT) AS c, q FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CENTROIDS}),
"""
    for k in range(ROUNDS + 1):
        out += f"a{k} AS MATERIALIZED (SELECT r, min({{'d': CAST({far} AS BIGINT), 'c': c}}) AS b FROM v, c{k} AS c GROUP BY r),\n"
        if k < ROUNDS:
            out += f"""m{k} AS (SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(q) AS x, unnest(range({DIMENSIONS})) AS k FROM a{k} JOIN v USING (r)) GROUP BY 1, 2),
n{k} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY k) AS q FROM m{k} GROUP BY 1),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN n{k} USING (c)),
"""
    return out + f"""z AS (SELECT vec_id, b.c AS cluster, b.d AS distance FROM a{ROUNDS} JOIN v USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM z JOIN c{ROUNDS} AS c ON z.cluster = c.c"""


SQL = _sql()
