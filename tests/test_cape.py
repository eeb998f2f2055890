"""CAPE and CIN against a column by hand, and against plain Python, level by level."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewind.functions import thermo

RD, CP, G, EPS = 287.04, 1004.0, 9.81, 0.622


def es(t):
    return 6.112 * math.exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5))


def theta_e(p, t, q, lcl):
    return t * (1000 / p) ** (0.2854 * (1 - 0.28 * q)) * math.exp((3376 / lcl - 2.54) * q * (1 + 0.81 * q))


def condensed(p, t, q):
    return min(2840 / (3.5 * math.log(t) - math.log(q * p / (EPS + q)) - 4.805) + 55, t)


def wet(goal, p):
    """By halving."""
    low, high = 100.0, min(goal * (p / 1000) ** 0.2854, 320.0)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if theta_e(p, mid, EPS * es(mid) / (p - es(mid)), mid) < goal else (low, mid)
    return low


def virtual(t, q):
    return t * (EPS + q) / (EPS * (1 + q))


def plain(levels):
    levels = sorted(((p, t, max(q, 1e-10)) for p, t, q in levels if all(x is not None and math.isfinite(x) for x in (p, t, q))), key=lambda x: -x[0])
    if len(levels) < 3:
        return None, None
    z = [0.0]
    for (p0, t0, q0), (p1, t1, q1) in zip(levels, levels[1:], strict=False):
        z.append(z[-1] + RD / G * (virtual(t0, q0) + virtual(t1, q1)) / 2 * math.log(p0 / p1))
    k = max((n for n in range(len(levels)) if z[n] <= 3000), key=lambda n: (theta_e(*levels[n], condensed(*levels[n])), -z[n]))
    middle = max(z[k], 250)
    own = [n for n in range(len(levels)) if abs(z[n] - middle) <= 250 or n == k]
    qk = sum(levels[n][2] for n in own) / len(own)
    pk = levels[k][0]
    tk = sum(levels[n][1] * (1000 / levels[n][0]) ** (RD / CP) for n in own) / len(own) * (pk / 1000) ** (RD / CP)
    lcl = condensed(pk, tk, qk)
    goal, plcl = theta_e(pk, tk, qk, lcl), pk * (lcl / tk) ** (CP / RD)
    b = []
    for p, t, q in levels[k:]:
        tp = tk * (p / pk) ** (RD / CP) if p >= plcl else wet(goal, p)
        b.append(G * (virtual(tp, qk if p >= plcl else min(EPS * es(tp) / (p - es(tp)), qk)) / virtual(t, q) - 1))
    up = down = 0.0
    for n, (x, y) in enumerate(zip(b, b[1:], strict=False)):
        fine = np.linspace(x, y, 20001)
        dz = z[k + n + 1] - z[k + n]
        plus, minus = (float(np.trapezoid(f(fine, 0))) / 20000 * dz for f in (np.maximum, np.minimum))
        if up == 0 and not x > 0:
            down += minus
        up += plus
    return up, down if up else 0.0


def test_buoyancy_of_one_percent(spark):
    """Dry air one percent colder than what rises from the lowest level: 0.01 g times the height, less half of the first layer."""
    p = np.array([1000.0, 930, 880, 850, 800])
    dry = 300 * (p / 1000) ** (RD / CP)
    t = [300.0, *(dry[1:] / 1.01)]
    rows = [(1, float(a), float(b), 0.0) for a, b in zip(p, t, strict=True)]
    z = RD / G * sum((a + b) / 2 * math.log(c / d) for a, b, c, d in zip(t[1:], t[2:], p[1:], p[2:], strict=False))
    first = RD / G * (t[0] + t[1]) / 2 * math.log(1000 / 930)
    got = thermo.cape(spark.createDataFrame(rows, "k int, p double, t double, q double"), ["k"]).first()
    assert got["cape"] == pytest.approx(0.01 * G * (z + first / 2), rel=1e-4) and got["cin"] == 0


def test_stable_air_and_missing_levels(spark):
    p = np.arange(1000.0, 100, -50)
    rows = [(1, float(a), float(290 + (1000 - a) * 0.01), 0.001) for a in p] + [(2, 1000.0, 300.0, 0.01), (2, 900.0, 295.0, 0.01), (2, 800.0, None, 0.01), (2, 700.0, float("nan"), 0.01), (None, None, 1.0, 1.0)]
    got = {r["k"]: (r["cape"], r["cin"]) for r in thermo.cape(spark.createDataFrame(rows, "k int, p double, t double, q double"), ["k"]).collect()}
    assert got == {1: (0.0, 0.0), 2: (None, None), None: (None, None)}


def test_many_columns(spark):
    rng = np.random.default_rng(6)
    columns = {}
    for k in range(60):
        p = np.sort(rng.uniform(150, 1010, rng.integers(3, 25)))
        t = 302 - (1000 - p) * rng.uniform(0.06, 0.1)
        q = 0.02 * np.exp(-(1000 - p) / rng.uniform(150, 400))
        t[rng.random(len(t)) < 0.1] = np.nan
        columns[k] = list(zip(p.tolist(), t.tolist(), q.tolist(), strict=True))
    rows = [(k, "x", *level) for k, levels in columns.items() for level in levels]
    df = thermo.cape(spark.createDataFrame(rows, "k int, h string, p double, t double, q double").repartition(3), ["k", "h"])
    got = {r["k"]: (r["cape"], r["cin"]) for r in df.collect()}
    assert sum((v[0] or 0) > 100 for v in got.values()) > 10 and any((v[1] or 0) < -1 for v in got.values())
    for k, levels in columns.items():
        up, down = plain(levels)
        if up is None:
            assert got[k] == (None, None)
        else:
            assert got[k] == (pytest.approx(up, rel=1e-5, abs=1e-4), pytest.approx(down, rel=1e-5, abs=1e-4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_shuffle_and_no_join(spark):
    """Columns aren't joined with what was found for them: with 120,000 of them that was broadcast."""
    rows = spark.range(50).selectExpr("id AS k", "explode(sequence(0, 15)) AS n").selectExpr("k", "1000.0D - 50 * n AS p", "300.0D + k / 25 - 4.2 * n AS t", "if(k = 7, NULL, 0.018 * exp(-0.25 * n)) AS q").repartition(3)
    df = thermo.cape(rows, ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {r["k"]: r["cape"] for r in df.collect()}
    assert len(got) == 50 and got[7] is None and sum(x is None for x in got.values()) == 1


def test_steps_end_on_the_adiabat(spark):
    pairs = [(goal, p) for goal in (280.0, 310.0, 350.0, 380.0) for p in (150.0, 300.0, 500.0, 700.0, 900.0, 1000.0)]
    got = spark.createDataFrame(pairs, "e double, p double").select("e", "p", thermo.pseudo_adiabat(F.col("e"), F.col("p")).alias("t")).collect()
    assert all(r["t"] == pytest.approx(wet(r["e"], r["p"]), abs=1e-8) for r in got)
