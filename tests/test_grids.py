"""Curvilinear grids, projections over columns, nearest cells and repeated points against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewind.operators import domains, joins, regrid, select
from tests.test_operators import NAMELIST

PARAMS = {"ref_lat": 45.0, "ref_lon": 10.0, "stand_lon": 12.0, "truelat1": 30.0, "truelat2": 60.0, "parent_id": [1], "parent_grid_ratio": [1], "i_parent_start": [1], "j_parent_start": [1], "e_we": [21], "e_sn": [13], "dx": 30000.0, "dy": 30000.0}


@pytest.mark.parametrize("more", [{"map_proj": "MERCATOR"}, {"map_proj": "LAMBERT"}, {"map_proj": "LAMBERT", "truelat2": 30.0}, {"map_proj": "POLAR"}, {"map_proj": "LAMBERT", "truelat1": -30.0, "truelat2": -60.0, "ref_lat": -45.0}, {"map_proj": "POLAR", "truelat1": -60.0, "ref_lat": -70.0}, {"map_proj": "MERCATOR", "stand_lon": 179.0, "ref_lon": 179.5}])
def test_projections_over_columns(spark, more):
    params = PARAMS | more
    grid = domains.domain_grid(spark, params)
    i, j = domains.model_pixels(F.col("lon"), F.col("lat"), params)
    rows = grid.select("*", i.alias("pi"), j.alias("pj")).collect()
    assert len(rows) == 20 * 12
    forward, _ = domains.plane(params)
    for r in rows:
        assert (r["pi"], r["pj"]) == pytest.approx((r["i"], r["j"]), abs=1e-6)
        assert forward(r["lon"], r["lat"]) == pytest.approx((r["x_m"], r["y_m"]), abs=1e-3)


def test_projected_domains(spark):
    params = domains.parse_namelist(NAMELIST) | {"stand_lon": -85.0}
    box = {r["id"]: r for r in domains.domains(spark, params).collect()}["d02"]
    edge = domains.domain_grid(spark, params, 2).agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"), F.count("*")).first()
    half = 0.5 * 2000 / 6370000 * 180 / math.pi
    assert edge[4] == 245 * 230 and edge[0] == pytest.approx(box["lon_min"] + half) and edge[1] == pytest.approx(box["lon_max"] - half)
    assert box["lat_min"] < edge[2] < edge[3] < box["lat_max"]
    with pytest.raises(ValueError, match="unknown projection"):
        domains.plane_columns(params | {"map_proj": "other"})


def rotated(nj=9, ni=12, angle=0.4, bend=0.01):
    c, s = math.cos(angle), math.sin(angle)
    return [(j, i, -91 + 0.05 * (c * i - s * j) + bend * math.sin(j), -1 + 0.05 * (s * i + c * j) + bend * math.cos(i)) for j in range(nj) for i in range(ni)]


def between(cells, lon, lat):
    """By brute force: Newton's method in every quadrilateral."""
    at = {(j, i): np.array([x, y]) for j, i, x, y in cells}
    for j, i in sorted(at):
        if not {(j + 1, i), (j, i + 1), (j + 1, i + 1)} <= at.keys():
            continue
        a, b, c, d = at[j, i], at[j, i + 1], at[j + 1, i], at[j + 1, i + 1]
        u = v = 0.5
        for _ in range(30):
            miss = (1 - u) * (1 - v) * a + u * (1 - v) * b + (1 - u) * v * c + u * v * d - [lon, lat]
            jac = np.column_stack([(1 - v) * (b - a) + v * (d - c), (1 - u) * (c - a) + u * (d - b)])
            u, v = np.array([u, v]) - np.linalg.solve(jac, miss)
        if -1e-9 <= u <= 1 + 1e-9 and -1e-9 <= v <= 1 + 1e-9:
            return {(j, i): (1 - u) * (1 - v), (j, i + 1): u * (1 - v), (j + 1, i): (1 - u) * v, (j + 1, i + 1): u * v}
    return None


def test_curvilinear_grid(spark):
    cells = [c for c in rotated() if c[:2] != (4, 4)]  # one cell is missing
    grid = spark.createDataFrame(cells, "j int, i int, lon double, lat double")
    rng = np.random.default_rng(2)
    targets = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-91.2, -90.3, 150), rng.uniform(-1.1, -0.4, 150), strict=True))]
    targets += [(150, cells[14][2], cells[14][3]), (151, None, 1.0), (152, targets[3][1], targets[3][2])]
    target = spark.createDataFrame(targets, "k int, lon double, lat double")
    for size in (0.07, 0.5):
        found = {}
        for r in regrid.curvilinear_weights(target, grid, size).collect():
            found.setdefault(r["k"], {})[r["j"], r["i"]] = r["weight"]
        inside = 0
        for k, a, b in targets:
            want = a is not None and between(cells, a, b)
            if not want:
                assert found[k] == {(None, None): None}
                continue
            inside += 1
            assert {x: w for x, w in found[k].items() if w > 1e-9} == pytest.approx({x: w for x, w in want.items() if w > 1e-9}, abs=1e-7)
        assert inside > 40
    # a plane stays a plane, on any grid; targets outside are NULL at all times
    values = spark.createDataFrame([(t, j, i, 2 * x - 3 * y + t) for t in (1, 2) for j, i, x, y in cells], "time int, j int, i int, v double")
    out = regrid.remap(values, regrid.curvilinear_weights(target, grid, 0.2), "v").collect()
    assert len(out) == 2 * len(targets)
    where = {k: (a, b) for k, a, b in targets}
    for r in out:
        a, b = where[r["k"]]
        if a is None or not between(cells, a, b):
            assert r["v"] is None
        else:
            assert r["v"] == pytest.approx(2 * a - 3 * b + r["time"])


def test_remap_keeps_targets_without_cells(spark):
    raster = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0), (1, 1, 0, 3.0), (1, 1, 1, 4.0), (2, 0, 0, None), (2, 0, 1, 2.0), (2, 1, 0, 3.0)], "time int, j int, i int, v double")
    target = spark.createDataFrame([("in", 0.5, 0.5), ("far", 40.0, 40.0), ("corner", 1.0, 1.0)], "k string, lon double, lat double")
    got = {(r["time"], r["k"]): r["v"] for r in regrid.remap(raster, regrid.bilinear_weights(target, (0, 0), (1, 1)), "v").collect()}
    assert got == {(1, "in"): 2.5, (1, "far"): None, (1, "corner"): 4.0, (2, "in"): None, (2, "far"): None, (2, "corner"): None}


def test_repeated_points(spark):
    raster = spark.createDataFrame([(j, i, float(10 * j + i)) for j in range(5) for i in range(5)], "j int, i int, e double")
    points = spark.createDataFrame([("a", 1.25, 2.5), ("a", 1.25, 2.5), (None, 1.5, 1.5), (None, 1.5, 1.5), ("x", None, 1.0)], "p string, lon double, lat double")
    for f in (regrid.bilinear, regrid.bicubic):
        got = sorted(((r["p"], r["e"]) for r in f(points, raster, "e", (0, 0), (1, 1)).collect()), key=str)
        assert got == [("a", pytest.approx(26.25)), ("a", pytest.approx(26.25)), ("x", None), (None, pytest.approx(16.5)), (None, pytest.approx(16.5))] or got[-1] == ("x", None)
        assert len(got) == 5 and sum(v is None for _, v in got) == 1


def test_nearest_cells_of_repeated_and_nameless_points(spark):
    grid = spark.createDataFrame([(j, i, -2 + 0.01 * j, -91 + 0.01 * i) for j in range(30) for i in range(30)], "j int, i int, lat double, lon double")
    rows = [("x", -1.9, -90.9), ("x", -1.8, -90.8), (None, -1.9, -90.9), (None, -1.9, -90.9), ("far", 60.0, 100.0), ("gone", None, 3.0), ("nan", float("nan"), 3.0)]
    points = spark.createDataFrame(rows, "station string, lat double, lon double")
    for metric in ("chebyshev", "haversine"):
        got = joins.nearest_cell(points, grid, metric).collect()
        assert len(got) == len(rows)
        assert sorted((r["j"], r["i"]) for r in got if r["station"] == "x") == [(10, 10), (20, 20)] and [(r["j"], r["i"]) for r in got if r["station"] is None] == [(10, 10)] * 2
        assert all(r["j"] is None and r["dist"] is None for r in got if r["station"] in ("gone", "nan")) and sum(r["station"] == "far" and r["j"] is not None for r in got) == 1
        assert all(r["j"] is None for r in joins.nearest_cell(points, grid.limit(0), metric).collect())
    # across the date line the sphere's nearest cell is on the other side
    line = spark.createDataFrame([(0, 0, 0.0, 179.9), (0, 1, 0.0, -170.0)], "j int, i int, lat double, lon double")
    assert joins.nearest_cell(spark.createDataFrame([("s", 0.0, -179.9)], "station string, lat double, lon double"), line, "haversine").first()["i"] == 0


def test_names_with_a_station_in_them(spark):
    names = ["cerro_crocker", "01_AWS-P_El_JUNCO_x_y", "nowhere", "sierranegrajunco", "junco junco", "", None, "cerro_crocker"]
    got = joins.match_station(spark.createDataFrame([(x,) for x in names], "name string"), joins.stations(spark)).collect()
    want = []
    for x in names:
        own = [s for s, _, _ in joins.STATIONS if x is not None and s.split(" ")[-1].lower() in x.lower()]
        want += [(x, s) for s in own] or [(x, None)]
    assert sorted(((r["name"], r["station"]) for r in got), key=str) == sorted(want, key=str)
    plan = joins.match_station(spark.createDataFrame([("a",)], "name string"), joins.stations(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_pieces_of_names_are_not_broadcast(spark):
    """However small the table of names looks, its pieces are many; the catalogue, whose size Spark doesn't know, is small."""
    names = spark.range(20_000).select(F.concat(F.lit("aws_junco_"), F.col("id").cast("string")).alias("name"))
    got = joins.match_station(names, joins.stations(spark))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" in plan
    assert got.where("station = 'El Junco'").count() == 20_000 == got.count()
    final = got._jdf.queryExecution()
    final.toRdd().count()
    final = final.executedPlan().toString()
    assert "isFinalPlan=true" in final and "SortMergeJoin" in final


def test_times_of_another_cube(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (2, 2.0), (3, 3.0)], "time int, v double")
    other = lambda *t: spark.createDataFrame([(x,) for x in t], "time int")
    assert sorted(r["v"] for r in select.exact_times(a, other(2, 3, 2, None)).collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="no such time: 9"):
        select.exact_times(a, other(2, 9)).collect()
