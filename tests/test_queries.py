"""Every query against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in __spark_entry__.queries().items() if not k.startswith("op") and k != "pipeline"}
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLE:
        assert rows
        return
    found = db.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert rows == sorted([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_imports_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # can't be imported
    assert "pipeline" not in __spark_entry__.queries()
    monkeypatch.setitem(sys.modules, "cubewind.llm.queries", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
