"""Language of a text by prediction by partial matching over bytes.

Each language has a context tree: how often a byte followed each context of up to ORDER bytes. A byte costs -log2 of its
probability in the longest context that the tree has; where it never followed it, the escape is paid for and the next shorter
context decides, without the bytes that the longer one would have predicted (method C with exclusion). After the context of
length 0, all bytes not seen in the language are equally likely. A text's code length is the sum over its bytes; statistics
stay frozen, so lengths are exact and don't depend on the order of texts. The least code length names the language.

Trees are arrays sorted by context, with a column per language, for all languages at once. The cost of each run of ORDER + 1
bytes that some language has is computed once; a task looks up the distinct runs of some texts there, and goes down the trees
only for runs that no language has.

The trees are fitted on about SAMPLE rows per language, whole texts, chosen by a hash of the row; Spark counts them. A language
with fewer rows takes part with all of them. The trees, some ten MB, are broadcast; that depends on SAMPLE and the number of
languages (meant to be some tens), not on the table.

Cases: a text that is null or has no letter is `und` with score 0; so is every text if there is nothing to learn from. Texts
without a lang and rows without a doc_id aren't learnt from (such rows count as not held out). Of equal code lengths the
language first by name is taken. Rows are told apart, so repeated doc_ids get a row each. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.tables import in_batches
from cubewind.llm.textscan import buffers

ORDER = 4
#: Labelled rows per language that the trees are fitted on, about
SAMPLE = 3000
UNKNOWN = "und"
#: Bytes whose runs are sorted at once; one longer text is a piece of its own.
PIECE_BYTES = 250_000


def runs(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row of some rows, where the runs of each begin (one more at the end), and the runs: of each byte itself and the
    ORDER bytes before it as a number. A text begins after ORDER zero bytes."""
    offsets, data = buffers(col)
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        size = np.diff(offsets[a : z + 1])
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat((np.arange(len(size)) + 1) * ORDER, size)
        b = np.zeros(int(size.sum()) + ORDER * len(size), np.int64)
        b[at] = data[offsets[a] : offsets[z]]
        whole = np.zeros(len(at), np.int64)
        for k in range(ORDER, -1, -1):
            whole = (whole << 8) | b[at - k]
        yield a, np.append(begin, len(at)), whole
        a = z


def _place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys have what is wanted, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


class Trees:
    """Context trees of some languages, from runs, their language's number and how often they occur."""

    def __init__(self, langs: list[str], run: np.ndarray, lang: np.ndarray, count: np.ndarray):
        self.langs = langs
        self.grams: list[np.ndarray] = []  # by order: context and byte, sorted
        self.counts: list[np.ndarray] = []  # languages beside one another
        self.contexts: list[np.ndarray] = []
        self.total: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        for order in range(ORDER + 1):
            grams, own = np.unique(run & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.zeros((len(grams), len(langs)), np.int64)
            np.add.at(counts, (own, lang), count)
            contexts, first = np.unique(grams >> 8, return_index=True)
            self.grams.append(grams)
            self.counts.append(counts)
            self.contexts.append(contexts)
            self.total.append(np.add.reduceat(counts, first, axis=0))
            self.kinds.append(np.add.reduceat((counts > 0).astype(np.int64), first, axis=0))
        # what the next shorter context has besides the bytes that a context has itself
        self.rest: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((1, len(langs)), np.int64),) * 2]
        for order in range(1, ORDER + 1):
            shorter, _ = _place(self.grams[order - 1], self.grams[order] & ((1 << 8 * order) - 1))
            seen = np.where(self.counts[order] > 0, self.counts[order - 1][shorter], 0)
            _, first = np.unique(self.grams[order] >> 8, return_index=True)
            above, _ = _place(self.contexts[order - 1], self.contexts[order] & ((1 << 8 * (order - 1)) - 1))
            self.rest.append((self.total[order - 1][above] - np.add.reduceat(seen, first, axis=0), self.kinds[order - 1][above] - self.kinds[order]))
        self.costs = self.cost(self.grams[ORDER])

    def cost(self, run: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run after the others, a column per language."""
        shape = len(run), len(self.langs)
        bits, done = np.zeros(shape), np.zeros(shape, bool)
        # of the context that the byte is looked for in: its rows without what a longer one has ruled out, and their kinds
        total, kinds, entered = np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
        for order in range(ORDER, -1, -1):
            gram = run & ((1 << 8 * (order + 1)) - 1)
            node, there = _place(self.contexts[order], gram >> 8)
            leaf, known = _place(self.grams[order], gram)
            here = there[:, None] & (self.total[order][node] > 0)
            fresh = here & ~entered
            total = np.where(fresh, self.total[order][node], total)
            kinds = np.where(fresh, self.kinds[order][node], kinds)
            entered |= here
            count = np.where(known[:, None], self.counts[order][leaf], 0)
            hit = here & ~done & (count > 0)
            missed = here & ~done & (count == 0) & (total + kinds > 0)
            size = np.maximum(total + kinds, 1)
            bits += np.where(hit, np.log2(size / np.maximum(count, 1)), 0.0) + np.where(missed, np.log2(size / np.maximum(kinds, 1)), 0.0)
            done |= hit
            if order:
                total = np.where(here, self.rest[order][0][node], total)
                kinds = np.where(here, self.rest[order][1][node], kinds)
        never = 256 - self.kinds[0][0] if len(self.kinds[0]) else np.full(len(self.langs), 256)
        return bits + np.where(done, 0.0, np.log2(np.maximum(never, 1)))

    def lengths(self, col: pa.Array) -> np.ndarray:
        """Code lengths in bits, rows x languages; 0 for null and empty texts."""
        out = np.zeros((len(col), len(self.langs)))
        for row, first, run in runs(col):
            each, own = np.unique(run, return_inverse=True)
            at, known = _place(self.grams[ORDER], each)
            bits = self.costs[at]
            bits[~known] = self.cost(each[~known])
            some = np.flatnonzero(np.diff(first))
            for k in range(len(self.langs)):
                if len(some):
                    out[row + some, k] = np.add.reduceat(bits[own, k], first[some])
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang = b.column("lang").dictionary_encode()
        number = lang.indices.to_numpy(zero_copy_only=False)
        for row, first, run in runs(b.column("text")):
            own = np.repeat(number[row : row + len(first) - 1], np.diff(first))
            for k in np.unique(own):
                each, n = np.unique(run[own == k], return_counts=True)
                yield pa.record_batch([pa.array([lang.dictionary[int(k)].as_py()] * len(each)), pa.array(each), pa.array(n)], names=["lang", "run", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """docs: doc_id, text, lang. Held-out rows are not read. None if there is nothing to learn from."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    share = own.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))  # a row per language
    among = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = own.join(F.broadcast(share), "lang").where(among < F.col("share")).select("lang", "text")
    found = in_batches(rows, _counted, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()  # of the sample
    if not found.num_rows:
        return None
    langs = sorted(set(found["lang"].unique().to_pylist()))
    number = {x: k for k, x in enumerate(langs)}
    coded = found["lang"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    lang = np.array([number[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
    return Trees(langs, found["run"].to_numpy(), lang, found["n"].to_numpy())


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, lang_pred and score: the share of the language's probability of the text in those of all languages."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(letter, F.col("text")).alias("text"))
    if trees is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in batches:
            bits = trees.lengths(b.column("text"))
            best = bits.argmin(1)
            score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
            gone = b.column("text").is_null().to_numpy(zero_copy_only=False)
            yield pa.record_batch([b.column("doc_id"), pa.array([UNKNOWN if g else trees.langs[k] for g, k in zip(gone, best, strict=True)], pa.string()), pa.array(np.where(gone, 0.0, score))], names=["doc_id", "lang_pred", "score"])

    return in_batches(rows, run, f"doc_id {kind}, lang_pred string, score double")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
