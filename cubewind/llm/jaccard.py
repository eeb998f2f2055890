"""Exact Jaccard self-join of word shingle sets by PartEnum signatures.

Two sets link when 100 * intersection >= percent * union. Then their sizes are in one size band or in two that meet, and
the number k of shingles in only one of them is bounded by the band. The shingle domain is partitioned in n1 parts and each
of these in n2; a part with k2 differences or fewer agrees on some n2 - k2 of its sub-parts, and k differences leave at least
n1 - k // (k2 + 1) such parts. Each set is given one signature per part and subset of sub-parts. Linked sets agree in that
many parts, always, so a set that shares signatures in fewer parts has no link and is left out before anything is compared.

Sets that share signatures for pairs whose larger set is in one band, directly or through others, form candidate clusters. A
cluster is dealt to blocks of bounded size, and every pair of blocks counts intersections in numpy and returns a spanning
forest of its links and each set's number of links, so no pair is a row. Links then give components. Rows of equal sets are
one class from the start.

Shingles are compared by 64-bit hashes: two different ones among the shingles of a pair of sets of 10,000 are taken for one
with a probability of 10^-11. Nulls and texts without words have an empty set and no links. Fewer words than a shingle are
one shingle. Rows that share a doc_id, null too, are rows of their own; component_id is the least doc_id there is among them.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.components import components
from cubewind.llm.tables import discard, give_back, in_batches, keep, located, unused, with_groups
from cubewind.llm.textscan import SPACED, mix, pieces, windows

SHINGLE = 3
PERCENT = 90
#: The pipeline's stage has no contract of its own: five words and 0.8.
STAGE_SHINGLE = 5
STAGE_PERCENT = 80
#: Bits of a signature that tell its part.
PART_BITS = 15
#: Shingles and sets in a block of a cluster.
BLOCK_SHINGLES = 400_000
BLOCK_SETS = 1000
#: Up to this many sets, intersections are one matrix product.
DENSE_SETS = 64
#: Sets in clusters, six numbers each, that are broadcast to find their texts; of more the texts are shuffled.
BROADCAST_SETS = 300_000


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for w in pieces(column, SPACED):
        h, doc, _ = windows(w, size)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[first], doc[first]
        to = np.searchsorted(doc, np.arange(len(w.rows) + 1))
        for k, row in enumerate(w.rows.tolist()):
            words = w.hash[w.first[k] : w.first[k + 1]]
            if 0 < len(words) < size:
                whole = np.array([len(words)], np.uint64)
                for x in words:
                    whole = mix(whole * np.uint64(5) + x)
                yield row, whole
            else:
                yield row, h[to[k] : to[k + 1]]


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> np.ndarray:
    """Largest size of each band: a set of a band links with none beyond the next band."""
    tops, low = [], 1
    while low <= largest:
        tops.append(low * 100 // percent)
        low = tops[-1] + 1
    return np.array(tops)


def partition(k: int, percent: int) -> tuple[int, int, int, int]:
    """n1, n2 and k2 for k differences, and the number of parts that agree. At thresholds with many differences parts would be
    small if pairs of sub-parts were signatures; there each sub-part is one, and more parts than one have to agree."""
    if percent >= 85:
        agree = 1 + k // 16
        return k // 2 + agree, 3, 1, agree
    agree = 1 + k // 4
    return k + agree, 1, 0, agree


def band_of(size: int, percent: int) -> tuple[np.ndarray, int]:
    """All bands and the number of the one that size is in."""
    largest = 64
    while largest < 2 * size + 2:
        largest *= 2
    tops = bands(percent, largest)
    return tops, int(np.searchsorted(tops, size))


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int]]:
    """PartEnum signatures of one set, for pairs whose larger set is in its band and in the next; their last 16 bits are the
    part and whether the band is odd. Also the parts that must agree, in even and odd bands. More parts than 15 bits can tell
    apart are counted by runs of 2, 4, 8 ... parts: sets that agree in so many parts agree in as many runs as those must fill."""
    tops, band = band_of(len(shingles), percent)
    out, need = [], [1, 1]
    value = mix(shingles)
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    for instance in (band, band + 1):
        k = int(2 * tops[instance] * (100 - percent) // (100 + percent))
        if not k:  # only equal sets link, and those are one class
            continue
        n1, n2, k2, agree = partition(k, percent)
        run = max(0, (n1 - 1).bit_length() - PART_BITS)
        need[instance % 2] = -(-agree >> run)
        part = (mix(shingles + np.uint64(instance + 1)) % np.uint64(n1 * n2)).astype(np.int64)
        sums = [np.bincount(part, x, n1 * n2).reshape(n1, n2) for x in (low, high)]
        which = np.arange(n1, dtype=np.uint64)
        told = (which >> np.uint64(run)) * np.uint64(2) + np.uint64(instance % 2)
        for number, subset in enumerate(combinations(range(n2), n2 - k2)):
            a, b = (s[:, subset].sum(axis=1).astype(np.uint64) for s in sums)
            tag = which + np.uint64(number << 40) + np.uint64(instance << 48)
            own = mix(mix(a * np.uint64(3) + mix(tag + np.uint64(1))) + mix(b + np.uint64(7)))
            out.append((own & ~np.uint64(0xFFFF)) | told)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), need


_FEATURES = "doc_id long, at struct<file: long, row: long>, n_shingles long, s1 long, s2 long, band int, even int, odd int, signatures array<long>"


def _features(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()  # a set that a task meets again is signed once
        for batch in batches:
            rows, n, s1, s2, band, need, sigs = [], [], [], [], [], [], []

            def out(batch=batch):
                picked = pa.array(rows, pa.int64())
                return pa.record_batch(
                    [
                        batch.column("doc_id").take(picked),
                        batch.column("at").take(picked),
                        pa.array(n, pa.int64()),
                        pa.array(np.array(s1, np.uint64).view(np.int64)),
                        pa.array(np.array(s2, np.uint64).view(np.int64)),
                        pa.array(band, pa.int32()),
                        *[pa.array([x[k] for x in need], pa.int32()) for k in range(2)],
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sigs])]), pa.int32()), pa.array(np.concatenate([*sigs, np.zeros(0, np.uint64)]).view(np.int64))),
                    ],
                    names=["doc_id", "at", "n_shingles", "s1", "s2", "band", "even", "odd", "signatures"],
                )

            for row, h in shingle_sets(batch.column("text"), size):
                rows.append(row)
                n.append(len(h))
                s1.append(mix(h).sum(dtype=np.uint64))
                s2.append(mix(h * np.uint64(7) + np.uint64(11)).sum(dtype=np.uint64))
                key = (len(h), int(s1[-1]), int(s2[-1]))
                own, parts = (h[:0], [0, 0]) if key in seen or not len(h) else signatures(h, percent)
                sigs.append(own)
                need.append(parts)
                band.append(band_of(len(h), percent)[1])
                seen.add(key)
                if len(rows) == 2000:
                    yield out()
                    rows, n, s1, s2, band, need, sigs = [], [], [], [], [], [], []
            yield out()

    return run


def _sets(size: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h in shingle_sets(batch.column("text"), size):
                one = [batch.column(c).slice(row, 1) for c in columns]
                yield pa.record_batch([*one, pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=[*columns, "shingles"])

    return run


def _stacked(run):
    """Few large batches instead of many small ones."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.nbytes
            if n > 4_000_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a block pair; shingles that most sets hold are counted by their absence."""
    m = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    end = np.append(begin[1:], len(flat))
    if m <= DENSE_SETS:
        count = end - begin
        column = np.repeat(np.where(count > 1, np.cumsum(count > 1) - 1, -1), count)
        owner, column = owner[column >= 0], column[column >= 0]
        product = np.zeros((m, m), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            x, z = np.searchsorted(column, (a, a + 8192))
            has = np.zeros((m, 8192), np.float32)
            has[owner[x:z], column[x:z] - a] = 1
            product += has @ has.T
        return product.astype(np.int32)
    both = np.zeros((m, m), np.int32)
    common, lacking = 0, np.zeros(m, np.int32)
    for a, z in zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True):
        has = owner[a:z]
        if 2 * len(has) > m:
            has = np.setdiff1d(np.arange(m), has, assume_unique=True)
            common += 1
            lacking[has] += 1
        if len(has) > 1:
            both[has[:, None], has] += 1
        elif len(has):
            both[has[0], has[0]] += 1
    both += common - lacking[:, None] - lacking[None, :]
    return both


def _verify(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        weight = table.column("weight").to_numpy()
        side = table.column("block").to_numpy()
        values = table.column("shingles").combine_chunks()
        raw, to = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        sets = [raw[a:z] for a, z in zip(to[:-1], to[1:], strict=True)]
        size = np.diff(to)
        same = intersections(sets)
        band = table.column("band").to_numpy()
        larger = table.column("larger")[0].as_py()
        one = len(np.unique(side)) == 1
        linked, degree = np.zeros(same.shape, bool), np.zeros(len(ids), np.int64)
        for k in range(0, len(ids), 256):  # some rows at a time, as whole matrices of numbers are large
            own = slice(k, k + 256)
            linked[own] = 100 * same[own] >= percent * (size[own, None] + size[None, :] - same[own])
            linked[own] &= np.maximum(band[own, None], band[None, :]) == larger
            if not one:
                linked[own] &= side[own, None] != side[None, :]
            linked[np.arange(len(ids))[own], np.arange(len(ids))[own]] = False
        if one and table.column("i")[0].as_py() != table.column("j")[0].as_py():
            linked[:] = False  # one block of the pair is empty
        for k in range(0, len(ids), 256):
            degree[k : k + 256] = linked[k : k + 256] @ weight
        todo = np.ones(len(ids), bool)
        a, b = [], []
        for k in range(len(ids)):
            if not todo[k]:
                continue
            todo[k] = False
            front = [k]
            while front:
                x = front.pop()
                new = np.flatnonzero(linked[x] & todo)
                todo[new] = False
                a += [ids[x]] * len(new)
                b += ids[new].tolist()
                front += new.tolist()
        some = np.flatnonzero(degree)
        del same, linked, sets
        give_back()
        return pa.table({"a": pa.array([*a, *ids[some].tolist()], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()), "n_links": pa.array([*[0] * len(a), *degree[some].tolist()], pa.int64())})

    return run


def _node(even: Column) -> Column:
    """A hash of half of a set's digest and of whether the band of a pair's larger set is even. The last bit says whether that is
    the set's own band. Two sets of one node only make a cluster larger."""
    own = (F.col("band") % 2 == 0) == even
    return F.xxhash64("s1", even).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(own.cast("long"))


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (rows that it links with)."""
    at = unused(docs, "_at")
    return _joined(located(docs, at), at, size, percent).drop("at", "keep_at")


def _joined(docs: DataFrame, at: str, size: int, percent: int) -> DataFrame:
    """The join with the place `at` of each row, which docs has under that name, and `keep_at` of the row that stays."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(at).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    signed = keep(in_batches(texts, _features(size, percent), _FEATURES), "features")
    features = keep(signed.drop("signatures"), "sets")
    key = ["n_shingles", "s1", "s2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first")
    classes = features.where("n_shingles > 0").groupBy(*key).agg(first, F.count(F.lit(1)).alias("weight"), *[F.max(c).alias(c) for c in ("band", "even", "odd")])
    classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # one shuffle serves both uses of the signatures; sets that share one have no link by it if none of them is in the larger band
    node = _node(F.col("signature") % 2 == 0).alias("node")
    some = F.max(F.col("node").bitwiseAND(1)).alias("own")
    each = signed.where("n_shingles > 0").select("s1", "band", F.explode("signatures").alias("signature")).select(node, "signature").repartition("signature")
    shared = each.groupBy("signature").agg(F.min("node").alias("least"), F.max("node").alias("most"), some).where("least <> most AND own = 1").drop("most", "own")
    met = keep(each.join(shared, "signature").drop("least"), "met")
    discard(signed)
    # sets that agree with others in too few parts have no link; without them others may have too few as well
    even = F.explode(F.array(F.lit(True), F.lit(False))).alias("even_")
    nodes = classes.select("id", "n_shingles", "weight", "band", F.col("first.at").alias("rep"), "s1", "even", "odd", even)
    nodes = nodes.select("id", "n_shingles", "weight", "band", "rep", _node(F.col("even_")).alias("node"), F.when(F.col("even_"), F.col("even")).otherwise(F.col("odd")).alias("need"), (F.col("band") + ((F.col("band") % 2 == 0) != F.col("even_")).cast("int")).alias("larger"))
    agreed = met.select("node", F.col("signature").bitwiseAND(65535).alias("part")).distinct().groupBy("node").count()
    able = agreed.join(nodes.select("node", "need"), "node").where("count >= need").select("node")
    left = met.join(able, "node", "left_semi")
    least = left.groupBy("signature").agg(F.min("node").alias("least"), some).where("own = 1").drop("own")
    near = left.join(least, "signature").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    clusters = components(near)

    inside = clusters.withColumnRenamed("id", "node").join(nodes, "node").drop("node", "need")
    n = F.count(F.lit(1))
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(n / BLOCK_SETS), F.ceil(n / (BLOCK_SETS // 5 + 10 * F.sqrt(n))))
    inside = inside.join(inside.groupBy("component").agg(blocks.alias("blocks")), "component")
    inside = keep(inside.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "clusters")
    columns = ["id", "component", "larger", "band", "weight", "block", "blocks"]
    asked = inside.select(*columns, "rep")
    few = asked.count() <= BROADCAST_SETS
    sets = texts.join(F.broadcast(asked) if few else asked, texts["at"] == asked["rep"]).select(*columns, "text")
    sets = in_batches(sets, _stacked(_sets(size, columns)), "id long, component long, larger int, band int, weight long, block long, blocks long, shingles array<long>")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    checked = keep(pairs.groupBy("component", "i", "j").applyInArrow(_verify(percent), "a long, b long, n_links long"), "checked")

    discard(met)
    found = components(checked.where("b IS NOT NULL").select("a", "b"))
    degree = checked.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n_links").alias("links"))
    linked = keep(classes.select("id", *key, "first").join(found, "id").join(degree, "id"), "linked")
    heads = keep(linked.groupBy("component").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("size")), "heads")
    linked = with_groups(linked.drop("first"), heads, ["component"], "size").select(*key, "head", "links")
    named = classes.join(linked, key, "left").select(*key, "weight", F.coalesce("head", "first").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = with_groups(features.drop("band", "even", "odd"), keep(named, "named"), key, "weight")
    one = F.col("head").isNull()  # an empty set
    return out.select("doc_id", "at", "n_shingles", F.when(one, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(one, F.col("at")).otherwise(F.col("head.at")).alias("keep_at"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row, that of the smallest doc_id, of each group of near duplicates. Rows without words all stay."""
    at = unused(docs, "_at")
    rows = located(docs, at)
    found = _joined(rows, at, STAGE_SHINGLE, STAGE_PERCENT)
    gone = keep(found.where("at <> keep_at").select(F.col("at").alias(at)), "near-copies")
    discard(found)
    return rows.join(gone, at, "left_anti").select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS k FROM a WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
