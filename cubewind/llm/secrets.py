"""Secrets in whole texts: base patterns, and runs of characters that a Markov model of random strings explains better.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled samples:
counts of character pairs by label, added up in Spark (two small tables whatever the input). Random are the values of base
spans and strings drawn from the usual alphabets of keys; ordinary are names in texts and, made of the texts' words, names in
camel, Pascal, snake, kebab and constant case, paths, file names, plain numbers, UUIDs and rules. A run of characters outside
the base spans is reported where the log-likelihood ratio of the models passes a threshold.

Null and empty texts have no spans. Repeated rows are scanned each. Extra columns are ignored. Without texts of words the
identifiers' model knows no names, only numbers, UUIDs and rules.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.tables import in_batches

#: About how many documents the labelled samples come from.
SAMPLE = 20_000
LEAST_LENGTH = 16
#: Labelled strings of each kind that are drawn for a document of the sample.
DRAWN = 6
#: Count of every pair of characters before any is seen.
PRIOR = 0.2
#: Share of the identifiers' model that depends on the kinds of two characters only: capital, small, digit, sign, edge.
BACKOFF = 0.2
#: Nats by which the random model must be ahead.
THRESHOLD = 12.0
KINDS = ("assign", "access", "hex", "random")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Fixed patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# every access and hex span of the least length lies in such a run
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# what is taken for an ordinary identifier: letters, and a short number at the end
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]{8,}[0-9]{0,3}(?![A-Za-z0-9_])")

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_SIZE = len(_ALPHABET) + 1  # the last is the edge of a string
_CODE = np.full(256, _SIZE - 1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[str]]:
    """Base spans (start, kind, end) in order, the runs in which others may be, and the values of the base spans."""
    found, values = [], []
    lower = text.lower()
    if any(k in lower for k in _KEYS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append((m.start(), 0, m.end()))
                values.append(m[2])
    runs = [m.span() for m in _RUN.finditer(text)]
    for a, z in runs:
        for m in _ACCESS.finditer(text, a, z):
            if m.end() - m.start() >= 20:
                found.append((m.start(), 1, m.end()))
                values.append(m[0])
        for m in _HEX.finditer(text, a, z):
            found.append((m.start(), 2, m.end()))
            values.append(m[0])
    found.sort()
    return found, runs, values


def pairs(strings: list[str]) -> np.ndarray:
    """Counts of character pairs, edges included."""
    if not strings:
        return np.zeros((_SIZE, _SIZE), np.int64)
    codes = _CODE[np.frombuffer(("\0" + "\0".join(strings) + "\0").encode("latin-1", "replace"), np.uint8)]
    return np.bincount(codes[:-1] * _SIZE + codes[1:], minlength=_SIZE * _SIZE).reshape(_SIZE, _SIZE)


_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{2,14}(?![A-Za-z])")
_KEY_ALPHABETS = (_ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:62] + "-_", _ALPHABET[:26] + _ALPHABET[52:62], _ALPHABET[26:62])


def random_string(draw: random.Random) -> str:
    return "".join(draw.choices(draw.choice(_KEY_ALPHABETS), k=draw.randrange(LEAST_LENGTH, 48)))


def ordinary_string(draw: random.Random, words: list[str]) -> str:
    """A name, path, number, UUID or rule; only the last three if there are no words."""
    kind = draw.randrange(10) if words else draw.randrange(7, 10)
    if kind == 9:
        return draw.choice("=-_+/.") * draw.randrange(LEAST_LENGTH, 60)
    if kind == 8:
        return str(uuid.UUID(int=draw.getrandbits(128)))
    if kind == 7:
        return draw.choice(("", "-")).join("".join(draw.choices("0123456789", k=4)) for _ in range(draw.randrange(4, 7)))
    few = [w.lower() for w in draw.choices(words, k=draw.randrange(2, 7))]
    number = str(draw.randrange(1000)) if draw.random() < 0.2 else ""
    if kind == 0:
        return few[0] + "".join(w.title() for w in few[1:]) + number
    if kind == 1:
        return "".join(w.title() for w in few) + number
    if kind == 6:
        return "/" + "/".join(few) + draw.choice(("", "/", ".html", ".txt", f"/{number}"))
    return ("_", "_", "-", ".")[kind - 2].join(w.upper() if kind == 3 else w for w in few) + number


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _SIZE, _SIZE), np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found, _, values = base_spans(text)
            counts[1] += pairs(values)
            spans = iter([*found, (len(text) + 1, 0, len(text) + 1)])
            a, _, z = next(spans)
            plain = []
            for m in _IDENTIFIER.finditer(text):
                while z <= m.start():
                    a, _, z = next(spans)
                if m.end() <= a:
                    plain.append(m[0])
            draw, words = random.Random(zlib.crc32(text.encode())), _WORD.findall(text)
            counts[0] += pairs([*plain, *(ordinary_string(draw, words) for _ in range(DRAWN))])
            counts[1] += pairs([random_string(draw) for _ in range(DRAWN)])
    label, one, two = np.nonzero(counts)
    yield pa.record_batch([pa.array(label, pa.int32()), pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(counts[label, one, two], pa.int64())], names=["label", "one", "two", "n"])


def ratio_of(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio by pair of characters, from counts by label (ordinary, random)."""
    counts = counts + PRIOR
    given = counts / counts.sum(axis=2, keepdims=True)
    # what pairs of kinds of characters tell about pairs that identifiers of other languages may have
    kind = np.array([0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in _ALPHABET] + [4])
    of = np.eye(5)[kind]
    kinds = of.T @ counts[0] @ of
    single = counts[0].sum(axis=0)
    less = (kinds / kinds.sum(axis=1, keepdims=True))[kind][:, kind] * single / (of.T @ single)[kind]
    return np.log(given[1]) - np.log((1 - BACKOFF) * given[0] + BACKOFF * less)


def train(texts: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log-likelihood ratio of each character pair: random strings against ordinary identifiers."""
    total = texts.count()
    rate = min(1.0, sample / max(total, 1))
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000)) if rate < 1 else texts
    rows = in_batches(some.select("text"), _samples, "label int, one int, two int, n long").groupBy("label", "one", "two").agg(F.sum("n").alias("n")).collect()  # two tables of character pairs
    counts = np.zeros((2, _SIZE, _SIZE))
    for r in rows:
        counts[r["label"], r["one"], r["two"]] = r["n"]
    return ratio_of(counts)


def scan(text: str, ratio: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) of a text, in order."""
    found, runs, _ = base_spans(text)
    more = []
    first = 0
    for a, z in runs:
        while first < len(found) and found[first][2] <= a:
            first += 1
        at, k = a, first
        while at < z:
            x, y = (found[k][0], found[k][2]) if k < len(found) and found[k][0] < z else (z, z)
            if x - at >= LEAST_LENGTH and is_random(text[at:x], ratio, threshold):
                more.append((at, 3, x))
            at, k = max(at, y), k + 1
    return sorted(found + more)


def is_random(run: str, ratio: np.ndarray, threshold: float = THRESHOLD) -> bool:
    codes = _CODE[np.frombuffer(("\0" + run + "\0").encode("latin-1", "replace"), np.uint8)]
    return bool(ratio[codes[:-1], codes[1:]].sum() > threshold)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text").to_pylist():
                found = scan(text, ratio)
                kinds = [k for _, k, _ in found]
                counts.append([kinds.count(k) for k in range(4)])
                digests.append(hashlib.sha256(written([s for s in found if s[1] < 3]).encode()).hexdigest())
                spans.append(written(found))
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.record_batch([batch.column("doc_id"), *n[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), n[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return find(docs, train(docs))
