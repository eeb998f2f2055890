"""Models of many series at once against matrices, one series at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewind.operators import regression
from tests.plain_models import fit_model


def many(seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for k, n in enumerate((3, 4, 7, 44, 300)):
        x = np.sort(rng.choice(np.arange(1900, 2300), n, replace=False)).astype(float)
        noise = np.cumsum(rng.normal(size=n)) if k % 2 else rng.normal(size=n) * (1 + (x - x[0]) / 100)
        y = 250 + 0.3 * x + noise
        if n > 5:
            y[2] += 60
        out[f"s{k}"] = (x, y)
    return out


def rows_of(spark, series):
    rows = [(k, float(a), float(b)) for k, (x, y) in series.items() for a, b in zip(x, y, strict=True)]
    rows += [("s2", None, 5.0), ("s2", 1950.0, None), ("short", 1.0, 2.0), ("short", 2.0, 3.0), ("one", 7.0, 1.0), ("one", 7.0, 2.0), ("one", 7.0, 4.0), ("none", None, None)]
    rows += [(None, float(a), float(b)) for a, b in zip(*series["s3"], strict=True)]
    return spark.createDataFrame(rows, "k string, x double, y double").repartition(3)


@pytest.mark.parametrize(("model", "mode"), [("ols", "textbook"), ("gls-ar1", "textbook"), ("gls-ar1", "inverted"), ("gls-hs", "textbook"), ("gls-hs", "inverted"), ("rls", "textbook")])
def test_models_of_many_series(spark, model, mode):
    series = many()
    df = rows_of(spark, series)
    got = {r["k"]: r for r in regression.fit(df, "y", "x", ["k"], model, mode).collect()}
    for k, (x, y) in {**series, None: series["s3"]}.items():
        a, b, t = fit_model(x, y, model, mode)
        assert got[k]["n"] == len(x)
        assert (got[k]["slope"], got[k]["intercept"]) == pytest.approx((b, a), rel=1e-5)
        assert got[k]["t"] == pytest.approx(t, rel=1e-4)
    assert got["one"]["slope"] is None
    if model != "ols":
        assert got["short"]["slope"] is None
    whole = regression.fit(df.where("k = 's3'"), "y", "x", (), model, mode).first()  # a series without a key
    assert whole["slope"] == pytest.approx(got["s3"]["slope"])
    plan = regression.fit(df, "y", "x", ["k"], model, mode)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert regression.fit(df.limit(0), "y", "x", ["k"], model, mode).count() == 0


def test_unknown_model(spark):
    with pytest.raises(ValueError, match="unknown model"):
        regression.fit(spark.range(3), "id", "id", (), "other")


def test_steps_of_robust_fits(spark):
    x, y = many()["s3"]
    design = np.column_stack([np.ones_like(x), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for steps in range(1, 4):
        rest = np.abs(y - design @ beta)
        w = np.minimum(1, 1.345 / np.maximum(rest / (np.median(rest) / 0.6744897501960817), 1e-12))
        beta = np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * y))
        got = regression.robust(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), "y", "x", (), steps).first()
        assert (got["intercept"], got["slope"]) == pytest.approx(tuple(beta), rel=1e-7)


def test_series_of_many_days(spark):
    """As long as a daily series of decades: nothing of n x n."""
    n = 16071
    df = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") * 0.01 + F.sin(F.col("id") * 0.37) + F.pmod(F.col("id") * 7919, F.lit(101)) / 50).alias("y"))
    for model, mode in (("gls-ar1", "textbook"), ("gls-ar1", "inverted"), ("rls", "textbook")):
        assert regression.fit(df, "y", "x", (), model, mode).first()["slope"] == pytest.approx(0.01, abs=1e-4)


def test_quantiles_of_students_t(spark):
    want = {1: 12.706205, 2: 4.302653, 5: 2.570582, 10: 2.228139, 42: 2.018082, 500: 1.964720}
    df = spark.createDataFrame([(k,) for k in [*want, 0, None]], "df int")
    got = {r["df"]: r["t"] for r in df.select("df", regression.t_column(F.col("df")).alias("t")).collect()}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=2e-6) and got[0] is None and got[None] is None
    assert regression.critical_t(5, 0.01) == pytest.approx(4.032143, abs=2e-6)


def test_bands_of_series_of_any_length(spark):
    series = {k: v for k, v in many().items() if len(v[0]) > 3}
    series["long"] = (np.arange(528.0), np.arange(528.0) % 13)
    got = regression.prediction_band(rows_of(spark, series | {"s3": series["s3"]}), "y", "x", by=["k"]).collect()
    for k, (x, y) in series.items():
        own = sorted((r["x"], r["fitted"], r["low"], r["high"]) for r in got if r["k"] == k and r["x"] is not None and r["y"] is not None)
        s, c = np.polyfit(x, y, 1)
        mean = c + s * x
        spread = np.sqrt(((y - mean) ** 2).sum() / (len(x) - 2))
        half = regression.critical_t(len(x) - 2) * spread * np.sqrt(1 / len(x) + (x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
        assert np.array(own) == pytest.approx(np.column_stack([x, mean, mean - half, mean + half]), rel=1e-7)
    assert all(r["low"] is None for r in got if r["k"] in ("short", "one"))


def test_adjustment_under_signal(spark):
    """Nearly all values are small; bins get about as many each."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random(1980) * 0.005, rng.random(20)])
    order = np.argsort(p)
    want = np.empty(len(p))
    want[order] = np.minimum(np.minimum.accumulate((p[order] * len(p) / (np.arange(len(p)) + 1))[::-1])[::-1], 1)
    df = spark.createDataFrame([(float(x),) for x in p], "p double")
    got = {r["p"]: r["p_adjusted"] for r in regression.adjusted(df, parts=20).collect()}
    assert [got[float(x)] for x in p] == pytest.approx(want.tolist())
    bounds = df.agg(F.percentile_approx("p", F.array(*[F.lit(k / 20) for k in range(1, 20)]), F.lit(400)).alias("b"))
    most = df.join(F.broadcast(bounds)).groupBy(F.size(F.filter("b", lambda b: b < F.col("p"))).alias("bin")).count().agg(F.max("count")).first()[0]
    assert most <= 2 * len(p) / 20
