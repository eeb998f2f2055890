"""Token counts under a unigram vocabulary: forward scores over a trie of the distinct pre-tokens.

A pre-token is a run without ASCII white space, with the vocabulary's word mark before it. Its tokens are those of the
segmentation with the highest sum of piece scores, the fewest of equal sums. The best score of a prefix depends on nothing
after it, so the distinct pre-tokens of a piece of the table are inserted in a trie, each node is scored once from the nodes
above it, and the count is stored where a pre-token ends. A worker remembers hashes and counts of pre-tokens.

The tokens are those of the vocabulary file read as a unigram model. Its file gives ranks and no probabilities, so the score of
the k-th piece is that of Zipf's law, the logarithm of 1 / (k H), where H makes the probabilities add up to 1. Nothing is
trained. A character that no piece covers counts as its UTF-8 bytes. Null and empty texts have no tokens. Repeated rows are
counted each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.tables import in_batches
from cubewind.llm.textscan import SPACED_EXACT, pieces

MARK = "▁"
#: Pre-tokens that a worker remembers; then it starts afresh.
REMEMBERED = 1_500_000


def endings(scores: dict[str, float]) -> dict[str, float | None]:
    """Scores of pieces, and None for other strings that a piece ends with."""
    return {x[k:]: None for x in scores for k in range(1, len(x))} | scores


class Trie:
    """Distinct words as a tree of prefixes. Nodes are numbered so that a node comes after those above it."""

    def __init__(self, words: list[str]):
        """words must be sorted."""
        self.words = words
        self.depth, self.word = [0], [0]  # of each node, and a word that goes through it
        self.ends: list[int] = []  # the node of each word
        path, before = [0], ""
        for number, word in enumerate(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                path.append(len(self.depth))
                self.depth.append(depth)
                self.word.append(number)
            self.ends.append(path[-1])
            before = word

    def counts(self, table: dict[str, float | None], byte_score: float) -> list[int]:
        """Tokens of each word. table: what endings() returns."""
        best, count = [0.0] * len(self.depth), [0] * len(self.depth)
        path = [0]
        for node in range(1, len(self.depth)):
            z, word = self.depth[node], self.words[self.word[node]]
            del path[z:]
            above = path[-1]
            n = len(word[z - 1].encode())
            top, least = best[above] + n * byte_score, count[above] + n
            for a in range(z - 1, -1, -1):
                s = table.get(word[a:z], False)
                if s is None:
                    continue
                if s is False:  # no piece ends like this
                    break
                above = path[a]
                s += best[above]
                if s > top or (s == top and count[above] + 1 < least):
                    top, least = s, count[above] + 1
            path.append(node)
            best[node], count[node] = top, least
        return [count[node] for node in self.ends]


def count_all(words: list[str], scores: dict[str, float], byte_score: float) -> list[int]:
    """Tokens of each word; words must be sorted."""
    return Trie([MARK + w for w in words]).counts(endings(scores), byte_score)


def zipf(pieces_: list[str]) -> dict[str, float]:
    """Scores of pieces in the order of their ranks."""
    logs = np.log(np.arange(1, len(pieces_) + 1))
    return dict(zip(pieces_, (-logs - np.log(np.exp(-logs).sum())).tolist(), strict=True)) if pieces_ else {}


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.scores = zipf([model.id_to_piece(i) for i in sorted(plain, key=lambda i: (-model.get_score(i), i))])
        self.byte_score = min(self.scores.values(), default=0.0) - 10.0
        self.table = endings(self.scores)
        self.clear()

    def clear(self) -> None:
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, words, tokens) by pieces of the column."""
        for w in pieces(column, SPACED_EXACT, 3_000_000):
            distinct, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(self.hash) > REMEMBERED:
                self.clear()
            place = np.searchsorted(self.hash, distinct)
            known = np.zeros(len(distinct), bool)
            if len(self.hash):
                known = self.hash[np.minimum(place, len(self.hash) - 1)] == distinct
            if not known.all():
                new = np.flatnonzero(~known)
                words = sorted((w.data[w.start[k] : w.end[k]].tobytes().decode(), n) for n, k in enumerate(at[new].tolist()))
                fresh = np.zeros(len(new), np.int64)
                fresh[[n for _, n in words]] = Trie([MARK + x for x, _ in words]).counts(self.table, self.byte_score)
                where = np.searchsorted(self.hash, distinct[new])
                self.hash, self.count = np.insert(self.hash, where, distinct[new]), np.insert(self.count, where, fresh)
                place = np.searchsorted(self.hash, distinct)
            tokens = np.concatenate([[0], np.cumsum(self.count[place][inverse])]).astype(np.int64)
            yield int(w.rows[0]), np.diff(w.first), np.diff(tokens[w.first])


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One for all tasks of a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_tokens."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cubewind.llm import token_counts as own  # by name, or each task would unpickle a vocabulary of its own

        vocabulary = own.vocabulary_of(path)
        for batch in batches:
            for row, words, tokens in vocabulary.counts(batch.column("text")):
                yield pa.record_batch([batch.column("doc_id").slice(row, len(words)), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return in_batches(texts, run, "doc_id long, n_words long, n_tokens long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
