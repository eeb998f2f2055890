"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become classes: insult, threat, target, negation, reported speech, other. Four transducers rewrite them in a clause:
an insult after a negation is denied, one after a verb of saying is quoted, a threat after either is only mentioned; what
follows a target is aimed, and so is a threat that a target follows. What comes out has weights; the transducers are composed to one machine. Insults are learnt
from labels: words and word beginnings that toxic texts have and others don't, in many different contexts, so that a text and
its copies teach nothing by themselves. The weights of threats with and without a target come from the labels too, in every
clause that has a threat or an insult. The k-th match of a word in a text counts one k-th. A logistic curve, fitted on the same
labelled rows, maps the evidence of a text to a score.

Labels are read from a bounded sample of the rows that are not held out. Null and empty texts have no evidence and get the
score of that. Without labels of both kinds nothing is toxic and every score is 0. Repeated rows are scored each; of
contradicting labels of one doc_id toxic counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.tables import in_batches
from cubewind.llm.textscan import ALNUM, Words, mix, pieces

#: About how many labelled rows are read; they bound how many words and word beginnings are learnt.
SAMPLE = 12_000
STEM_BYTES = 4
LEAST_CONTEXTS = 4
LEAST_ODDS = 3.0
TOXIC = 0.7
#: Steps of the logarithm of evidence for which labelled rows are counted.
BINS = 50

# Fixed word lists, lower case
TARGETS = "you your yours yourself he she they them him her tu toi vous te ton ta du dich dir ihr sie él ella usted ustedes tú ti".split()
NEGATIONS = "not no never neither nor isn aren wasn cannot ne pas jamais aucun ni nicht kein keine nie niemals nunca jamás tampoco".split()
REPORTED = "said says wrote writes claimed claims quoted called told allegedly reported dit disait écrit prétend sagte sagt schrieb behauptet dijo dice escribió afirma".split()
THREATS = "kill murder hurt destroy beat shoot burn stab tuer frapper brûler töten schlagen erschießen verbrennen matar golpear quemar".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, SAYING, DENIED, QUOTED, MENTIONED, AIMED = range(10)
_WEAKER = {INSULT: (DENIED, QUOTED), THREAT: (MENTIONED, MENTIONED)}
Transducer = dict[tuple[int, int], tuple[int, int]]


def _transducer(states: int, rule) -> Transducer:
    return {(s, c): rule(s, c) for s in range(states) for c in range(10)}


def negation() -> Transducer:
    """State: words for which a negation still holds."""
    return _transducer(4, lambda s, c: (3, c) if c == NEGATION else (max(s - 1, 0), _WEAKER[c][0] if s and c in _WEAKER else c))


def reported() -> Transducer:
    """State: whether somebody says what follows in the clause."""
    return _transducer(2, lambda s, c: (1, c) if c == SAYING else (s, _WEAKER[c][1] if s and c in _WEAKER else c))


def aimed() -> Transducer:
    """State: for how many words more a target is near."""
    return _transducer(6, lambda s, c: (5, c) if c == TARGET else (max(s - 1, 0), AIMED if s and c in (INSULT, THREAT) else c))


def threatened() -> Transducer:
    """State: for how many words more a threat waits for its target."""
    return _transducer(5, lambda s, c: (4, c) if c == THREAT else (0, AIMED) if s and c == TARGET else (max(s - 1, 0), c))


#: How much of a word's weight counts, by the class that comes out.
WEIGHTS = {INSULT: 1.0, AIMED: 1.5, QUOTED: 0.6, DENIED: 0.5, THREAT: 0.3, MENTIONED: 0.15}


def compose(*machines: Transducer) -> dict[tuple[int, int], tuple[int, float]]:
    """One machine from state and class to state and weight; the output of each transducer is the input of the next."""
    start = (0,) * len(machines)
    number, todo, table = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for c in range(6):
            out, to = c, []
            for s, machine in zip(state, machines, strict=True):
                s, out = machine[s, out]
                to.append(s)
            if (to := tuple(to)) not in number:
                number[to] = len(number)
                todo.append(to)
            table[number[state], c] = (number[to], WEIGHTS.get(out, 0.0))
    return table


GRAMMAR = compose(negation(), reported(), aimed(), threatened())


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginning; a word that isn't longer has no beginning of its own."""
    stem = np.full(len(w.hash), 0xA5, np.uint64)
    for k in range(STEM_BYTES):
        b = w.data[np.minimum(w.start + k, max(len(w.data) - 1, 0))]
        stem = mix(stem * np.uint64(3) + ALNUM.value[b])
    return w.hash, np.where(w.end - w.start > STEM_BYTES, stem, 0)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.concatenate([w.hash for w in pieces(pa.array([" ".join(words)]), ALNUM)])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        out = []
        for w in pieces(batch.column("text"), ALNUM, 4_000_000):
            doc = w.doc()
            bad = toxic[w.rows][doc]
            after = np.zeros(len(doc), np.uint64)
            after[:-1] = w.hash[1:]
            bit = np.uint64(1) << (mix(after) % np.uint64(63))
            for f in features(w):
                order = np.lexsort((doc, f))
                f, d, b, m = f[order], doc[order], bad[order], np.where(bad, bit, 0)[order]
                at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
                first = np.ones(len(f), bool)
                first[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                if len(at):
                    out.append((f[at], np.add.reduceat((first & b).astype(np.int64), at), np.add.reduceat((first & ~b).astype(np.int64), at), np.bitwise_or.reduceat(m, at)))
        for f, good, other, m in out:
            yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(good), pa.array(other), pa.array(m.view(np.int64))], names=["feature", "toxic", "other", "contexts"])


class Lexicon:
    def __init__(self, insults: dict[int, float], a: float = -30.0, b: float = 0.0):
        self.hash = np.array(sorted(insults), np.uint64)
        self.weight = np.array([insults[int(h)] for h in self.hash])
        self.a, self.b = a, b
        #: Weight of a threat that is aimed, and of any other, until labels say more.
        self.aimed, self.unaimed = LEAST_ODDS, LEAST_ODDS
        self.threats = word_hashes(THREATS)
        self.classes = {int(h): c for words, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTED, SAYING), (THREATS, THREAT)) for h in word_hashes(words)}

    def weights(self, f: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(f))
        at = np.minimum(np.searchsorted(self.hash, f), len(self.hash) - 1)
        return np.where(self.hash[at] == f, self.weight[at], 0.0)

    def evidence(self, w: Words, met: dict[int, int] | None = None) -> np.ndarray:
        """Of each row: the weights of the patterns that its clauses match. met takes up for each row with threats 1 if one is aimed and 2 if one isn't, or their sum."""
        word, stem = features(w)
        weight = np.maximum(self.weights(word), self.weights(stem))
        out = np.zeros(len(w.rows))
        doc = w.doc()
        starts = np.flatnonzero((weight > 0) | np.isin(word, self.threats))
        ends = np.isin(w.data, list(b".!?;\n")).astype(np.int64).cumsum() if len(starts) else np.zeros(0)
        done: set[tuple[int, int]] = set()
        counted: dict[tuple[int, int], int] = {}
        for k in starts.tolist():
            d, clause = int(doc[k]), int(ends[w.start[k]])
            if (d, clause) in done:
                continue
            done.add((d, clause))
            a = k
            while a > w.first[d] and ends[w.start[a - 1]] == clause:
                a -= 1
            state = 0
            while a < w.first[d + 1] and ends[w.start[a]] == clause:
                c = INSULT if weight[a] else self.classes.get(int(w.hash[a]), OTHER)
                state, share = GRAMMAR[state, c]
                if share:
                    counted[key] = counted.get(key := (d, int(word[a])), 0) + 1
                    hit = share == WEIGHTS[AIMED]
                    out[d] += share * (weight[a] or (self.aimed if hit else self.unaimed)) / counted[key]
                    if met is not None and not weight[a]:
                        met[d] = met.get(d, 0) | (1 if hit else 2)
                a += 1
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * evidence, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope for labels y at x with counts n, slightly drawn to 0."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(n * (y - p)).sum(), (n * (y - p) * x).sum()]) - 0.1 * np.array([a, b])
        v = n * p * (1 - p)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _evidence(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in pieces(batch.column("text"), ALNUM, 1_000_000):
                bins = np.round(np.log1p(lexicon.evidence(w)) * BINS).astype(np.int64)
                yield pa.record_batch([pa.array(bins), batch.column("toxic").slice(int(w.rows[0]), len(w.rows))], names=["bin", "toxic"])

    return run


def _threats(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in pieces(batch.column("text"), ALNUM, 1_000_000):
                met: dict[int, int] = {}
                lexicon.evidence(w, met)
                yield pa.record_batch([pa.array([met.get(k, 0) for k in range(len(w.rows))], pa.int64()), batch.column("toxic").slice(int(w.rows[0]), len(w.rows))], names=["met", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """docs: doc_id, text; labels: doc_id, toxic. Held-out rows are not read."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = own.count()
    rate = int(1_000_000 * min(1.0, sample / max(total, 1)))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # about `sample` pairs of two numbers, whatever the table
    rows = docs.join(F.broadcast(own), "doc_id").select("text", "toxic")
    both = rows.groupBy("toxic").count().collect()
    n = {int(r["toxic"]): r["count"] for r in both}
    if not (n.get(0) and n.get(1)):
        return Lexicon({})
    found = in_batches(rows, _learn, "feature long, toxic long, other long, contexts long").where("feature <> 0").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("other") + 0.5) / (n[0] + 1))
    found = found.where(F.col("contexts") >= LEAST_CONTEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    lexicon = Lexicon({r["feature"] & (2**64 - 1): r["odds"] for r in found.select("feature", "odds").collect()})  # words of the sample
    met = [(r["met"], int(r["toxic"]), r["count"]) for r in in_batches(rows, _threats(lexicon), "met long, toxic int").where("met > 0").groupBy("met", "toxic").count().collect()]  # 6 rows at most
    weights = []
    for bit in (1, 2):
        bad, other = (sum(c for m, toxic, c in met if m & bit and toxic == t) for t in (1, 0))
        odds = float(np.log((bad + 0.5) / (n[1] + 1)) - np.log((other + 0.5) / (n[0] + 1)))
        weights.append(max(odds, 0.0) if bad + other else LEAST_ODDS)
    lexicon.aimed, lexicon.unaimed = weights
    bins = in_batches(rows, _evidence(lexicon), "bin long, toxic int").groupBy("bin", "toxic").count().collect()  # some hundred rows
    lexicon.a, lexicon.b = logistic(np.array([np.expm1(r["bin"] / BINS) for r in bins]), np.array([float(r["toxic"] > 0) for r in bins]), np.array([float(r["count"]) for r in bins]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row: doc_id, score, evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in pieces(batch.column("text"), ALNUM):
                e = lexicon.evidence(w)
                yield pa.record_batch([batch.column("doc_id").slice(int(w.rows[0]), len(w.rows)), pa.array(lexicon.score(e)), pa.array(e)], names=["doc_id", "score", "evidence"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, evidence double")


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return score(texts, train(texts, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text isn't toxic, whatever their doc_id."""
    lexicon = train(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [lexicon.score(lexicon.evidence(w)) for w in pieces(batch.column("text"), ALNUM)]
            yield batch.filter(pa.array(np.concatenate([*scores, np.zeros(0)]) < TOXIC))

    return in_batches(docs, run, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")
