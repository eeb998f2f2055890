"""Stages of the pipeline on their own, against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cubewind.llm import exact_dedup, jaccard, toxicity
from cubewind.llm.textscan import ALNUM, pieces
from tests.llm.conftest import frame
from tests.llm.test_chat_html_toxicity import toxic_corpus
from tests.llm.test_text_operators import shingles


def brute_kept(rows, size, percent):
    """The smallest id of each component of links."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_near_duplicates_of_the_stage_are_five_words_and_four_fifths(spark):
    rng = random.Random(3)
    rows = []
    for k in range(0, 60, 3):  # a text, one with one to three words after it, and one with a word changed
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        changed = list(words)
        changed[rng.randrange(60)] = "other"
        rows += [(k, " ".join(words)), (k + 1, " ".join([*words, *[f"end{k}x{n}" for n in range(1 + k % 9)]])), (k + 2, " ".join(changed))]
    want = brute_kept(rows, 5, 80)
    assert want != brute_kept(rows, 3, 90)
    got = [r["doc_id"] for r in jaccard.stage(spark, frame(spark, rows), "").collect()]
    assert sorted(got) == sorted(want)


def test_linked_sets_agree_in_enough_parts():
    rng = np.random.default_rng(4)
    for _ in range(1000):
        n = int(rng.integers(1, 250))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, int(rng.integers(0, 2 + n // 8))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) > 0 and both < max(len(a), len(b)):
            (x, need), (y, other) = (jaccard.signatures(s, 80) for s in (a, b))
            tags = np.unique(np.intersect1d(x, y) & np.uint64(65535)) % np.uint64(2)
            assert any((tags == k).sum() >= max(need[k], other[k]) > 0 for k in range(2))


@pytest.mark.parametrize(("percent", "size"), [(80, 250_000), (80, 700_000), (90, 700_000), (80, 3000)])
def test_linked_sets_of_any_size_agree_in_enough_parts(percent, size, monkeypatch):
    if size == 3000:
        monkeypatch.setattr(jaccard, "PART_BITS", 5)  # the same by runs of many parts
    rng = np.random.default_rng(size)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    for share in (0.99, percent / 100 + 0.002):
        both = int(len(a) * 2 * share / (1 + share))
        b = np.sort(np.concatenate([a[rng.permutation(len(a))[:both]], rng.integers(0, 2**63, len(a) - both).astype(np.uint64)]))
        assert 100 * both >= percent * (2 * len(a) - both)
        (x, need), (y, other) = (jaccard.signatures(s, percent) for s in (a, b))
        tags = np.unique(np.intersect1d(x, y) & np.uint64(65535)) % np.uint64(2)
        assert any((tags == k).sum() >= max(need[k], other[k]) > 0 for k in range(2))


def test_very_long_near_duplicates(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(700_000)]
    changed = list(words)
    for _ in range(700):
        changed[rng.randrange(len(words))] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:300_000])), (4, "short")]
    assert sorted(r["doc_id"] for r in jaccard.stage(spark, frame(spark, rows), "").collect()) == [1, 3, 4]


def test_near_duplicates_without_and_with_repeated_ids(spark, empty):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text + " more"), (7, text + " and"), (7, text + " and"), (7, "something else"), (8, ""), (8, None), (None, "alone here")]
    got = [(r["doc_id"], r["text"]) for r in jaccard.stage(spark, frame(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(7, text + " and"), (7, "something else"), (8, ""), (8, None), (None, "alone here")], key=str)
    assert jaccard.stage(spark, empty, "").count() == 0 and jaccard.stage(spark, empty, "").columns == empty.columns


def test_threats_alone_are_toxic(spark):
    rows, labels, truth = toxic_corpus(600)
    clean = [(i, t) for i, t in rows if i in truth and not truth[i]][:150]
    threats = [(2000 + k, f"{t}. you will kill thea. {t}") for k, (_, t) in enumerate(clean)]  # one context: not learnt as a word
    docs = spark.createDataFrame([*rows, *threats, (5000, "")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, *[(i, 1) for i, _ in threats]], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, table)
    assert not lexicon.weights(toxicity.word_hashes(["kill"])).any()
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[i] >= toxicity.TOXIC for i, _ in threats) and got[5000] < 0.2


def test_evidence_against_plain_transducers():
    rng = random.Random(12)
    insults = {"scrundle": 4.0, "wazzock": 3.5}
    lexicon = toxicity.Lexicon({int(toxicity.word_hashes([w])[0]): x for w, x in insults.items()})
    lexicon.aimed, lexicon.unaimed = 5.0, 2.0
    lists = ((toxicity.TARGETS, toxicity.TARGET), (toxicity.NEGATIONS, toxicity.NEGATION), (toxicity.REPORTED, toxicity.SAYING), (toxicity.THREATS, toxicity.THREAT))
    words = [*insults, *toxicity.THREATS[:6], *toxicity.TARGETS[:5], *toxicity.NEGATIONS[:3], *toxicity.REPORTED[:3], *"tree of house on".split()]

    def plain(text):
        total, counted = 0.0, {}
        for clause in re.split(r"[.!?;\n]", text):
            states = [0, 0, 0, 0]
            machines = (toxicity.negation(), toxicity.reported(), toxicity.aimed(), toxicity.threatened())
            for word in clause.split():
                c = toxicity.INSULT if word in insults else next((c for own, c in lists if word in own), toxicity.OTHER)
                for k, machine in enumerate(machines):
                    states[k], c = machine[states[k], c]
                if share := toxicity.WEIGHTS.get(c):
                    counted[word] = counted.get(word, 0) + 1
                    total += share * insults.get(word, 5.0 if c == toxicity.AIMED else 2.0) / counted[word]
        return total

    texts = [" ".join(rng.choice(words) + rng.choice(("", "", "", ".", "!", ";")) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts = [t for t in texts if any(w in t for w in [*insults, *toxicity.THREATS])]
    found = np.concatenate([lexicon.evidence(w) for w in pieces(pa.array(texts), ALNUM)])
    assert found == pytest.approx([plain(t) for t in texts])
    one = lambda t: float(lexicon.evidence(next(pieces(pa.array([t]), ALNUM)))[0])
    assert one("kill you") > one("kill it") > one("not kill you") > one("tree") == 0 and one("you kill") > one("they said kill it") > 0


def test_one_row_of_equal_texts_stays_whatever_its_id(spark, empty):
    rows = [(None, "a b"), (None, "ab"), (3, "a b"), (3, "a b"), (4, "ab"), (5, "x"), (5, "y"), (None, "z"), (None, None), (6, " ")]
    got = [(r["doc_id"], r["text"]) for r in exact_dedup.stage(spark, frame(spark, rows), "").collect()]
    assert sorted(got, key=str) == sorted([(3, "a b"), (5, "x"), (5, "y"), (None, "z"), (6, " ")], key=str)
    groups = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert len(groups) == 10 and sum(r["kept"] for r in groups) == 5
    assert sorted(r["group_size"] for r in groups) == [1, 1, 1, 2, 2, 5, 5, 5, 5, 5]
    assert exact_dedup.stage(spark, empty, "").count() == 0


def test_toxicity_of_no_rows_and_without_labels(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.stage(spark, empty, str(tmp_path)).count() == 0
    rows = [(1, "a"), (None, None), (1, "a")]
    assert toxicity.stage(spark, frame(spark, rows), str(tmp_path)).count() == 3


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(30000))  # much longer than a sequence
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, None), (1, ""), (None, text), (2, text + " end"), (2, text), (3, long), (3, "other words"), (None, "other words"), (4, "clean")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _at long, _AT_ long, file string, row long"
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, 2, "f", 3) for i, t in rows], ddl)
    bench = spark.createDataFrame([(None, None), (1, ""), (2, "...")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for name, some in (("odd", docs), ("none", docs.limit(0))):
        for table, df in (("documents", some), ("benchmark", bench), ("labels", labels)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = sorted({r["doc_id"] for r in out}, key=str)
    assert kept == [1, 2, 3, 4] and sum(r["piece"] == 0 for r in out) == 5  # 3 twice: two texts
    assert max(r["piece"] for r in out) > 10 and len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.count() == 0 and "sequence_id" in none.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet"), f"{tmp_path}/odd").columns == docs.columns


def test_arrays_that_a_worker_cannot_see(tmp_path):
    from cubewind.llm.arrays import Store

    for uri in (f"{tmp_path}/a", f"file:{tmp_path}/b", f"file://{tmp_path}/c d"):
        store = Store(uri).made()
        store.put("x", np.arange(5))
        again = Store(uri)
        assert again.mounted and again.get("x", "<i8").tolist() == [0, 1, 2, 3, 4] and len(again.get("y", "<i8")) == 0
    with pytest.raises(FileNotFoundError, match="can't be seen here"):
        Store(f"file:{tmp_path}/none").get("x", "<i8")
    assert not Store("viewfs://store/in").mounted
