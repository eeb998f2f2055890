"""Vector operators and the language operator against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cubewind.llm import centroids, language, vector_codes

DDL = "vec_id long, embedding array<float>, label string, q int, cluster int, norms int, n int, code int, labelled int"


def vectors(seed=1, n=300):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, 64)) * 0.3
    rows = [(int(k), (middle[k % 8] + rng.normal(size=64) * 0.05).astype(np.float32).tolist(), f"l{k % 3}") for k in rng.permutation(n)]
    again = dict((k, v) for k, v, _ in rows)
    rows += [(5, again[5], None), (5, again[6], None), (7, again[7], "l0"), (None, again[8], None)]  # repeated, tied and missing ids
    rows += [(900, None, "x"), (901, [], "x"), (902, again[9][:63], "x"), (903, [*again[9][:63], None], "x"), (904, [*again[9][:63], float("nan")], "x"), (905, [*again[9][:63], float("inf")], "x")]
    rows += [(906, [3e38, *again[9][1:]], "x"), (907, [-3e38, *again[9][1:]], "x")]
    return rows


def written(spark, rows, path):
    spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], DDL).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def whole(rows, scale):
    fine = [(i, v, x) for i, v, x in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [max(-(2**27), min(2**27, math.floor(scale * float(np.float32(c))))) for c in v], x) for i, v, x in fine]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def least(q, entries):
    return min((apart(q, e), k) for k, e in enumerate(entries))


def brute_clusters(rows):
    kept = whole(rows, 64)
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q, _ in kept if i is not None)
    middle = [q for _, q in order[:16]]
    for _ in range(3):
        at = [least(q, middle)[1] for _, q, _ in kept]
        for c in range(len(middle)):
            own = [q for (_, q, _), k in zip(kept, at, strict=True) if k == c]
            if own:
                middle[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *least(q, middle)) for i, q, _ in kept]
    each = {}
    for _, d, c in found:
        each[c] = each.get(c, 0) + d
    name = lambda c: hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()
    return [(i, c, d, each[c], sum(each.values()), name(c)) for i, d, c in found]


@pytest.mark.parametrize("n", [300, 9])
def test_clusters(spark, tmp_path, n):
    rows = vectors(n=max(n, 12))[-n - 12 :] if n < 16 else vectors()
    got = centroids.op11(spark, written(spark, rows, tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_clusters(rows), key=str)


def test_screening_changes_nothing_and_saves_distances():
    rng = np.random.default_rng(3)
    middle = rng.integers(-40, 40, (16, 64))
    x = middle[rng.integers(0, 16, 3000)] + rng.integers(-3, 4, (3000, 64))
    x[:50] = middle[:1]  # ties
    middle[5] = middle[0]
    far = ((x[:, None] - middle[None]) ** 2).sum(2)
    at, best, taken = centroids.nearest(x, centroids.norms(x), middle)
    assert (at == far.argmin(1)).all() and (best == far.min(1)).all()
    assert taken < 0.5 * far.size
    big = np.full((2, 64), centroids.LARGEST)
    assert centroids.nearest(big, centroids.norms(big), -big)[1].tolist() == [64 * 2**56] * 2


def test_no_vectors(spark, tmp_path):
    path = written(spark, vectors()[-8:-2], tmp_path)  # none is whole
    assert centroids.op11(spark, path).count() == 0 and vector_codes.op12(spark, path).count() == 0
    assert vector_codes.op12(spark, path).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def brute_codes(rows):
    kept = whole(rows, 256)
    start = sorted((i, q) for i, q, _ in kept if i is not None)[:64]
    part = lambda q, p: q[4 * p : 4 * p + 4]
    books = [[part(q, p) for _, q in start] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            at = [least(part(q, p), books[p])[1] for _, q, _ in kept]
            for e in range(len(start)):
                own = [part(q, p) for (_, q, _), k in zip(kept, at, strict=True) if k == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = []
    for i, q, label in kept:
        both = [least(part(q, p), books[p]) for p in range(16)]
        found.append((i, "".join(f"{e:02x}" for _, e in both), sum(d for d, _ in both), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    each = {}
    for _, _, d, label in found:
        each[label] = each.get(label, 0) + d
    return [(i, code, d, each[label], digest) for i, code, d, label in found]


@pytest.mark.parametrize("n", [300, 9])
def test_codes(spark, tmp_path, n):
    rows = vectors(n=max(n, 12))[-n - 12 :] if n < 16 else vectors()
    got = vector_codes.op12(spark, written(spark, rows, tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_codes(rows), key=str)


def brute_bits(texts, text, order=language.ORDER):
    """Code length of text after texts: contexts in dictionaries, sets of excluded bytes."""
    seen = {}
    for t in texts:
        b = bytes(order) + t.encode()
        for k in range(order, len(b)):
            for n in range(order + 1):
                own = seen.setdefault(b[k - n : k], {})
                own[b[k]] = own.get(b[k], 0) + 1
    bits, b = 0.0, bytes(order) + text.encode()
    for k in range(order, len(b)):
        gone = set()
        for n in range(order, -1, -1):
            own = {s: c for s, c in seen.get(b[k - n : k], {}).items() if s not in gone}
            if b[k] in own:
                bits -= math.log2(own[b[k]] / (sum(own.values()) + len(own)))
                break
            if own:
                bits -= math.log2(len(own) / (sum(own.values()) + len(own)))
                gone |= set(own)
        else:
            bits += math.log2(256 - len(gone))
    return bits


def tongues(seed=4):
    rng = random.Random(seed)
    words = {x: ["".join(rng.choice(own) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for x, own in (("aa", "etaoins"), ("bb", "étaöins"), ("cc", "ktuvaßl"))}
    say = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    rows = [(k, say(x := rng.choice(list(words)), rng.randrange(3, 40)), x) for k in range(240)]
    return [*rows, (240, "", "aa"), (241, None, "bb"), (242, "1234 !?", "cc"), (243, say("bb", 3000), "bb"), (None, say("aa", 20), "aa"), (0, say("cc", 20), "cc"), (244, say("aa", 20), None)]


def test_code_lengths():
    rows = tongues()
    learnt = {x: [t for _, t, own in rows[:60] if own == x] for x in ("aa", "bb", "cc")}
    run, lang, count = [], [], []
    for k, x in enumerate(learnt):
        for _, _, r in language.runs(pa.array(learnt[x]), 200):
            each, n = np.unique(r, return_counts=True)
            run.append(each)
            lang.append(np.full(len(each), k))
            count.append(n)
    trees = language.Trees(list(learnt), np.concatenate(run), np.concatenate(lang), np.concatenate(count))
    texts = [t for _, t, _ in rows[60:90]] + ["", None, "東京 \x00\x00 zz", "q", "e" * 50, "\n"]
    got = trees.lengths(pa.array(texts))
    assert got == pytest.approx(np.array([[brute_bits(learnt[x], t or "") for x in learnt] for t in texts]))


def test_language(spark, tmp_path):
    rows = tongues()
    spark.createDataFrame([(i, t, x, "s", 1, 2) for i, t, x in rows], "doc_id long, text string, lang string, source string, share long, run long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op13(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: x for i, _, x in rows if i not in (0, None)}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {240, 241, 242}
    wrong = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] not in und and r["lang_pred"] != truth[r["doc_id"]]]
    assert len(wrong) <= 1 and sum(r["held_out"] for r in got) > 40


def test_held_out_rows_and_labels_are_not_read(spark):
    rows = [(i, t, x) for i, t, x in tongues() if i is not None]
    swapped = [(i, t if zlib.crc32(str(i).encode()) % 4 != 2 else "zzzz", x if zlib.crc32(str(i).encode()) % 4 != 2 else "other") for i, t, x in rows]
    ddl = "doc_id long, text string, lang string"
    a, b = (language.train(spark.createDataFrame(r, ddl)) for r in (rows, swapped))
    assert a.langs == b.langs == ["aa", "bb", "cc"] and all((x == y).all() for x, y in zip(a.counts, b.counts, strict=True))


def test_nothing_to_learn_from(spark, tmp_path, empty):
    spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/a/documents.parquet")
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert {(r["lang_pred"], r["score"]) for r in language.op13(spark, f"{tmp_path}/a").collect()} == {("und", 0.0)}
    assert language.op13(spark, f"{tmp_path}/b").count() == 0
