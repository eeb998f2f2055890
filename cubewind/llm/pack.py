"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids and a final id 0; only those longer than `capacity` are cut, into full pieces and a rest. The
histogram of piece lengths has at most `capacity` rows whatever the corpus size. Over it, a covering program (how often to
use each multiset of lengths that fits) is solved by multiplicative weights: each round prices the lengths, a knapsack
dynamic program finds the best configuration with each of the least covered lengths, each is used until the first of its
lengths is covered, and prices shrink with coverage. The rounds stop when all but `GAP` of the tokens are covered. The
fractional uses are rounded, and the pieces that remain (that gap, and less than a sequence for each configuration) are
packed best fit. Pieces are then ranked within their length, in parts of bounded size, and joined with slots.

Null and empty texts are one piece that holds id 0. Repeated doc_ids are packed as rows of their own but then share
(doc_id, piece). Ties go by doc_id and piece. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubewind.llm.tables import in_batches, keep
from cubewind.llm.textscan import PUNCTUATED, pieces

CAPACITY = 2048
#: Rounds at most, configurations of a round, share of the tokens that may stay uncovered.
ROUNDS = 400
LEAST_COVERED = 128
GAP = 0.005
#: Long pieces are dearer than their share of the capacity: short ones are needed to fill up what is left at the end.
PRICE_POWER = 1.1
#: Ids of distinct words that a worker remembers; then it starts afresh.
REMEMBERED = 400_000
#: Pieces of one length that one task ranks.
RANKED = 200_000


class WordEncoder:
    """Ids of whole texts. The tokenizer lower-cases and never joins across white space, nor a letter with punctuation other
    than an apostrophe, so each distinct run between such places is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hash, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes must ascend."""
        # a few at a time: what the library returns for a word is large
        fresh = [x.ids for k in range(0, len(words), 4096) for x in self.tokenizer.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(fresh), np.uint32, total)
        begin = self.used + np.cumsum(size) - size
        self.used += total
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.begin, self.size = np.insert(self.hash, at, hashes), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of the ids of each row) by pieces of the column; without the final id 0."""
        for w in pieces(column, PUNCTUATED, 2_000_000):
            distinct, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(self.hash) > REMEMBERED:
                self.clear()
            place = np.searchsorted(self.hash, distinct)
            known = np.zeros(len(distinct), bool)
            if len(self.hash):
                known = self.hash[np.minimum(place, len(self.hash) - 1)] == distinct
            if not known.all():
                new = np.flatnonzero(~known)
                self.learn(distinct[new], [w.data[a:z].tobytes().decode() for a, z in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)])
                place = np.searchsorted(self.hash, distinct)
            ids, to = gather(self.ids, self.begin[place][inverse], self.size[place][inverse])
            yield int(w.rows[0]), ids, to[w.first]


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs pool[begin : begin + size], one after the other, and their offsets."""
    to = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pool[np.arange(to[-1]) + np.repeat(begin - to[:-1], size)], to


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.uint32()))])
_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(texts: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cubewind.llm import pack  # by name, or each task would unpickle an encoder of its own

        encoder = pack.encoder_of(path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, ids, to in encoder.encode(batch.column("text")):
                n = len(to) - 1
                full = np.zeros(len(ids) + n, "<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(to))] = ids
                size = np.diff(to) + 1
                begin = np.cumsum(size) - size
                count = -(-size // capacity)
                which = np.repeat(np.arange(n), count)
                piece = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[which] - start)
                a = begin[which] + start
                raw = memoryview(full.tobytes())
                spans = list(zip((a * 4).tolist(), ((a + length) * 4).tolist(), strict=True))
                columns = [
                    doc_ids.take(pa.array(which + row)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(raw[x:y]) for x, y in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(full, pa.uint32())).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=_PIECE.names[: len(columns)])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return in_batches(texts, run, ddl)


Plan = dict[tuple[tuple[int, int], ...], int]


def knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> np.ndarray:
    """By capacity: the weight of the last item of the best filling, 0 where the last unit stays empty; any item may be taken
    again and again."""
    worth = np.full(capacity + 1, -np.inf)  # by weight, heaviest first
    worth[capacity - weight] = value
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = best[:c] + worth[capacity - c : capacity]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], c - k
        else:
            best[c] = best[c - 1]
    return last


def filling(last: np.ndarray, c: int) -> list[int]:
    """The weights that fill a capacity c best."""
    out = []
    while c > 0:
        if last[c]:
            out.append(int(last[c]))
        c -= max(int(last[c]), 1)
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Best fit, longest first, over a histogram: bins of equal contents are filled together."""
    room: dict[int, dict[tuple[tuple[int, int], ...], int]] = {capacity: {}}
    spaces = [capacity]
    for length, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while count:
            space = next((s for s in spaces if s >= length and (s != capacity)), None)
            if space is None:
                per = capacity // length
                own, bins = ((length, per),), count // per
                made = [(own, bins, capacity - per * length)] if bins else []
                if count % per:
                    made.append((((length, count % per),), 1, capacity - (count % per) * length))
                count = 0
            else:
                held = room[space]
                contents, bins = next(iter(held.items()))
                per = min(space // length, count)
                take = min(bins, count // per)
                held[contents] -= take
                if not held[contents]:
                    del held[contents]
                if not held:
                    spaces.remove(space)
                made = [(tuple(sorted([*contents, (length, per)], reverse=True)), take, space - per * length)]
                count -= take * per
            for contents, bins, left in made:
                held = room.setdefault(left, {})
                held[contents] = held.get(contents, 0) + bins
                if left not in spaces:
                    spaces.append(left)
                    spaces.sort()
    out: Plan = {}
    for held in room.values():
        for contents, bins in held.items():
            merged: dict[int, int] = {}
            for length, k in contents:
                merged[length] = merged.get(length, 0) + k
            key = tuple(sorted(merged.items(), reverse=True))
            out[key] = out.get(key, 0) + bins
    return out


def covering(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> dict[bytes, float]:
    """Fractional uses of configurations (numbers of each length, as bytes). lengths must ascend."""
    n = len(lengths)
    slot = np.zeros(capacity + 1, np.int64)
    slot[lengths] = np.arange(n)
    total = float((lengths * counts).sum())
    covered, used, tokens = np.zeros(n), {}, 0.0
    worth = (lengths / capacity) ** PRICE_POWER
    for _ in range(rounds):
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_) or tokens >= (1 - GAP) * total:
            break
        last = knapsack((worth * np.exp(-covered))[open_], lengths[open_], capacity)
        for k in open_[np.argsort(covered[open_] - 1e-6 * lengths[open_], kind="stable")[:LEAST_COVERED]].tolist():
            config = np.bincount(slot[[int(lengths[k]), *filling(last, capacity - int(lengths[k]))]], minlength=n)
            some = np.flatnonzero(config)
            step = ((1 - covered[some]) * counts[some] / config[some]).min()
            if step > 1e-9:
                covered[some] += config[some] * step / counts[some]
                used[key] = used.get(key := config.tobytes(), 0.0) + step
                tokens += float((config[some] * lengths[some]).sum()) * step
    return used


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[Plan, Plan]:
    """Configurations ((length, how many), ...) and how often to use each, those of the program and those of the rest; together
    they hold exactly the counts."""
    order = np.argsort(lengths)
    lengths, left = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    plan: Plan = {}
    due = 0.0
    for raw, uses in sorted(covering(lengths, left, capacity, rounds).items(), key=lambda x: (-x[1], x[0])):
        config = np.frombuffer(raw, np.int64)
        some = config > 0
        times = int(due + uses) - int(due)  # what is rounded off adds up for those that come next
        due += uses
        times = min(times, int((left[some] // config[some]).min()))
        if times:
            left -= config * times
            plan[tuple((int(a), int(b)) for a, b in zip(lengths[some][::-1], config[some][::-1], strict=True))] = times
    return plan, best_fit(lengths[left > 0], left[left > 0], capacity)


def slots(*plans: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, pieces of that length in one sequence, first sequence, offset in it)."""
    rows, rank, sequence = [], {}, 0
    for config, times in (x for plan in plans for x in sorted(plan.items(), reverse=True)):
        offset = 0
        for length, k in config:
            a = rank.get(length, 0)
            rows.append((length, a, a + k * times, k, sequence, offset))
            rank[length] = a + k * times
            offset += k * length
        sequence += times
    return rows


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give each piece a sequence_id and an offset. cut_pieces must be a written table: it is read twice."""
    spark = cut_pieces.sparkSession
    histogram = cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity rows at most
    plans = configurations(np.array([r["length"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), capacity, rounds)
    places = spark.createDataFrame(slots(*plans) or [(0, 0, 0, 1, 0, 0)], "length long, _a long, _z long, _k long, _sequence long, _offset long")
    salts = spark.createDataFrame([(r["length"], -(-r["n"] // RANKED)) for r in histogram], "length long, _salts long")
    salted = cut_pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = keep(counts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before")), "lengths")
    first = F.broadcast(counts)  # a row for each length and RANKED pieces of it
    ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(first, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_n"))
    at = F.col("_rank") - F.col("_a")
    # the places are those of ROUNDS * LEAST_COVERED configurations at most and of the rest, whatever the corpus size
    return ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_z"))).select(
        *[ranked[c] for c in cut_pieces.columns],
        (F.col("_sequence") + F.floor(at / F.col("_k"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_k")) * ranked["length"]).alias("offset"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return pack(keep(cut(texts, path or tokenizer_path(), capacity, with_ids), "pieces"), capacity)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: what is kept, packed."""
    return packed(docs)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
