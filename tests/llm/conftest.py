"""Small tables with nulls, empty and long texts, repetitions, near copies and columns whose names clash."""

import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, _kept long, rep long, component long, block long, weight long"


def corpus(seed: int = 5) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = [a + b for a in "the and or an ti on er ha wh sh".split() for b in "ea nt st ly ing ed re ou ble nd".split()]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, "  \t\n"), (3, "One"), (4, "one two"), (5, "ONE  two"), (6, "é ß 東京 ok"), (7, say(6000))]
    base = say(80)
    for k in range(10, 40):  # near copies in a chain and a star
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    rows += [(k, base.upper() if k % 2 else base + " ") for k in range(40, 60)]
    rows += [(k, say(rng.randrange(1, 120))) for k in range(60, 120)]
    short = say(12)
    rows += [(k, short + (" x" if k % 3 else "")) for k in range(120, 132)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame([(i, t, "en", "src0", None, 1, 2, 3, 4, 5) for i, t in rows], DDL).repartition(parts)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame(spark, rows).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
