"""Cases that the driver's tables don't hold: bounds, gaps, ties, leap years, known values."""

import datetime
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewind import model
from cubewind.functions import calendar, names, thermo, units
from cubewind.operators import domains, enso, joins, masks, reduce, regression, regrid, select, series
from cubewind.plans import trends
from cubewind.sources import files, netcdf, sinks
from cubewind.streaming import resample
from tests import plain_models

TS = datetime.datetime


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_time_bounds(spark):
    df = frame(spark, [(TS(2023, 12, 31),), (TS(2023, 12, 31, 0, 0, 1),), (TS(1980, 1, 1),), (TS(1979, 12, 31, 23),)], "time timestamp_ntz")
    assert select.time_slice(df, "1980-01-01", "2023-12-31").count() == 2
    assert select.date_slice(df, "1980-01-01", "2023-12-31").count() == 3
    plan = select.time_slice(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumnRenamed("l_shipdate", "time"), "1996-01-01", "1996-12-31")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_masks_keep_rows(spark):
    cube = frame(spark, [(TS(2000, 1, 1), 0, i, 1.0) for i in range(6)], "time timestamp_ntz, j int, i int, v double")
    grid = frame(spark, [(0, 0, 0.1, 1), (0, 1, 2000.0, 1), (0, 2, 2000.1, 1), (0, 3, 5.0, 0), (0, 4, None, 1)], "j int, i int, hgt double, landmask int")
    value = lambda df: [r["v"] for r in df.orderBy("i").collect()]
    assert value(masks.height_zone(cube, grid, 0.1, 2000)) == [1, 1, None, None, None, None]
    assert value(masks.half_open_zone(cube, grid, 0.1, 2000)) == [1, None, None, 1, None, None]
    assert value(masks.mask_sea(cube, grid)) == [None, None, None, 1, None, None]
    nan = frame(spark, [(math.nan, 1), (2.0, 2)], "v double, k int")
    assert model.without_nan(nan).agg(F.avg("v")).first()[0] == 2.0


def test_season_lengths(spark):
    days = spark.range(8).select((2023 + F.floor(F.col("id") / 4)).cast("int").alias("y"), (F.col("id") % 4 + 1).cast("int").alias("s")).orderBy("y", "s")
    assert [r[0] for r in days.select(calendar.days_in_season(F.col("y"), F.col("s"))).collect()] == [90, 91, 92, 92, 91, 91, 92, 92]
    assert [r[0] for r in days.select(calendar.days_in_year(F.col("y"))).collect()] == [365] * 4 + [366] * 4


def test_enso_ties_and_fixture_rules(spark):
    months = [(datetime.date(2000, m, 1), 1.13 if m == 6 else -1.13 if m == 8 else 0.0) for m in range(1, 13)]
    months += [(datetime.date(2001, m, 1), -1.13 if m == 6 else None if m == 2 else 0.0) for m in range(1, 13)]
    index = frame(spark, months, "time date, value double")
    assert {r["year"]: r["class"] for r in enso.classify_years(index, smooth=1).collect()} == {2000: 1, 2001: -1}
    assert {r["year"]: r["class"] for r in enso.classify_years(index).collect()} == {2000: 0, 2001: 0}
    assert {(r["season"], r["year"]): r["class"] for r in enso.classify_seasons(index).where("class <> 0").collect()} == {(2, 2000): 1, (3, 2000): -1, (2, 2001): -1}


def test_rolling_needs_all_values(spark):
    df = frame(spark, [(k, None if k == 7 else float(k)) for k in range(12)], "time int, value double")
    assert [r["rolling"] for r in series.rolling_mean(df, "value").orderBy("time").collect()] == [None] * 4 + [2.0, 3.0, 4.0] + [None] * 5


def test_daily_gaps(spark):
    df = frame(spark, [("a", TS(2022, 4, 1, 5), 1.0), ("a", TS(2022, 4, 1, 6), 2.0), ("a", TS(2022, 4, 4), 4.0)], "station string, ts timestamp_ntz, value double")
    assert [r["value"] for r in series.daily(df, "value", ["station"]).orderBy("day").collect()] == [3.0, 0.0, 0.0, 4.0]
    assert [r["value"] for r in series.daily(df, "value", ["station"], "mean").orderBy("day").collect()] == [1.5, None, None, 4.0]


@pytest.mark.parametrize(("t", "df"), [(2.22814, 10), (12.7062, 1), (2.01808, 42)])
def test_p_values(t, df):
    assert regression.p_value(t, df) == pytest.approx(0.05, abs=1e-6)
    assert regression.critical_t(df) == pytest.approx(t, abs=1e-4)


def test_degenerate_fits(spark):
    rows = [("perfect", x, 2.0 * x + 1) for x in range(5)] + [("two", 0, 1.0), ("two", 1, 2.0)] + [("constant", 3, float(k)) for k in range(4)] + [("flat", k, 1.0) for k in range(4)]
    got = {r["k"]: r for r in regression.ols(frame(spark, rows, "k string, x int, y double"), "y", "x", ["k"]).collect()}
    assert got["perfect"]["slope"] == pytest.approx(2) and got["perfect"]["t"] is None
    assert got["two"]["t"] is None and got["constant"]["slope"] is None


def test_trend_map_rules(spark):
    rows = [(0, 0, y, float(y)) for y in range(5)] + [(0, 1, y, None if y == 2 else float(y)) for y in range(5)] + [(0, 2, y, None) for y in range(5)] + [(0, 3, y, y + 0.1 * (-1) ** y) for y in range(5)]
    got = {r["i"]: r for r in regression.trend_map(frame(spark, rows, "j int, i int, year int, v double"), "v").collect()}
    assert set(got) == {0, 1, 3} and got[1]["slope"] is None and got[0]["slope"] == pytest.approx(1)
    assert [r["i"] for r in regression.significant(regression.trend_map(frame(spark, rows, "j int, i int, year int, v double"), "v")).collect()] == [3]


def test_significance_of_many_points(spark):
    rows = [(1, 3, 13.0), (2, 3, 12.0), (3, 200, 2.0), (4, 201, 2.0), (5, 201, 1.9), (6, 100000, -2.0), (7, 5000, None), (8, 2, 9.0)]
    got = regression.significant(frame(spark, rows, "k int, n long, t double")).collect()
    assert sorted(r["k"] for r in got) == [1, 3, 4, 6]


def test_models():
    x = np.arange(20.0)
    y = 3 + 0.5 * x + np.sin(x)
    a, b, t = plain_models.fit_model(x, y, "ols")
    assert (a, b) == pytest.approx(tuple(np.polyfit(x, y, 1)[::-1]))
    for m in ("gls-ar1", "gls-hs", "rls"):
        assert plain_models.fit_model(x, y, m)[1] == pytest.approx(0.5, abs=0.1)
    y[3] += 100
    assert abs(plain_models.fit_model(x, y, "rls")[1] - 0.5) < 0.1 < abs(plain_models.fit_model(x, y, "ols")[1] - 0.5)
    assert plain_models.fit_model(x, y, "gls-ar1", "inverted") != plain_models.fit_model(x, y, "gls-ar1")
    with pytest.raises(ValueError):
        plain_models.fit_model(x, y, "other")


def test_nearest_ties(spark):
    grid = frame(spark, [(0, 0, 0.0, 0.0), (0, 1, 0.0, 1.0), (1, 0, 1.0, 0.0)], "j int, i int, lat double, lon double")
    points = frame(spark, [("mid", 0.5, 0.5), ("east", 0.1, 0.9)], "station string, lat double, lon double")
    assert {r["station"]: (r["j"], r["i"]) for r in joins.nearest_cell(points, grid).collect()} == {"mid": (0, 0), "east": (0, 1)}
    assert {r["station"] for r in joins.nearest_cell(points, grid, "great_circle").collect()} == {"mid", "east"}


def test_attach_is_complete(spark):
    a = frame(spark, [(1, 0, 0, 1.0), (2, 0, 0, 2.0)], "time int, j int, i int, v double")
    assert joins.attach(a, a.withColumnRenamed("v", "u")).count() == 2
    with pytest.raises(Exception, match="no match"):
        joins.attach(a, a.where("time = 1").withColumnRenamed("v", "u")).collect()


def test_interpolation(spark):
    raster = frame(spark, [(j, i, float(10 * j + i)) for j in range(5) for i in range(5)], "j int, i int, e double")
    points = frame(spark, [("in", 1.25, 2.5), ("edge", 4.0, 4.0), ("out", 4.5, 1.0)], "p string, lon double, lat double")
    got = {r["p"]: r["e"] for r in regrid.bilinear(points, raster, "e", (0, 0), (1, 1)).collect()}
    assert got == {"in": pytest.approx(26.25), "edge": pytest.approx(44), "out": None}
    assert {r["p"]: r["e"] for r in regrid.bicubic(points, raster, "e", (0, 0), (1, 1)).collect()}["in"] == pytest.approx(26.25)


NAMELIST = """&share
 max_dom = 3,
/
&geogrid
parent_id         = 1, 1, 2,
parent_grid_ratio = 1, 5, 10,
i_parent_start    = 1, 67, 103,
j_parent_start    = 1, 78, 85,
e_we              = 300, 246, 400,
e_sn              = 210, 231, 350,
dx                = 10000,
dy                = 10000,
map_proj          = 'mercator',
ref_lat           = 0,
ref_lon           = -85,
truelat1          = 0,
stand_lon         = -87,
!opt_path         = 'geogrid/'
/
"""


def test_domains(spark):
    params = domains.parse_namelist(NAMELIST)
    rows = {r["id"]: r for r in domains.domains(spark, params | {"stand_lon": params["ref_lon"]}).collect()}
    known = {"d01": (-98.44697, -71.55303, -9.35751, 9.35751), "d02": (-92.51051, -88.10315, -2.47275, 1.66377), "d03": (-90.67561, -89.95784, -0.96238, -0.33460)}
    for k, v in known.items():
        assert [rows[k][c] for c in ("lon_min", "lon_max", "lat_min", "lat_max")] == pytest.approx(v, abs=2e-5)
    assert [rows[k]["dx"] for k in ("d01", "d02", "d03")] == [10000, 2000, 200]
    for kind in ("MERCATOR", "LAMBERT", "POLAR"):
        forward, back = domains.plane({"map_proj": kind, "ref_lat": 45.0, "ref_lon": 10.0, "stand_lon": 12.0, "truelat1": 30.0, "truelat2": 60.0})
        assert back(*forward(7.5, 51.0)) == pytest.approx((7.5, 51.0))


def test_names(spark):
    assert files.path_of("e1", "prcp", 2000, "d02", base="/x/") == "/x/e1/e1_d02_d_2d_prcp_2000.nc" and files.path_of("e1", "hgt") == "e1/e1_d02km_static_hgt.nc"
    assert files.elements_of("/x/e1_d02_d_2d_prcp_2000.nc") == {"experiment": "e1", "domain": "d02", "frequency": "d", "dimensions": "2d", "variable": "prcp", "year": "2000"}
    assert files.static_path("/x/e1_d02_d_2d_prcp_2000.nc", "hgt") == "/x/MM/MM_d02km_static_hgt.nc"
    assert files.variable_files(["a_d_2d_t2_2000.nc", "b_d_2d_t2_2000.nc", "b_h_2d_q2_2000.nc"], 2000, ["t2", "q2"]) == {"t2": "b_d_2d_t2_2000.nc"}
    assert units.conversion("k") == (1.0, -273.15, "degC") and units.conversion("m/s", "w")[2] == "cm/s"
    with pytest.raises(NameError):
        units.names_of("nothing")
    with pytest.raises(Exception, match="unknown projection"):
        frame(spark, [("1,2,3,4,5,6,7,WGS-84,Other",)], "a string").select(names.envi_projection(F.col("a"))).collect()
    assert names.axis_label("geopotential", "500-850") == "500-850 hPa layer thickness in m"


def test_adjustment_of_a_map(spark):
    rng = np.random.default_rng(2)
    p = [*np.round(rng.random(300) ** 2, 3).tolist(), 0.0, 1.0, 1.0]
    order = sorted(p)
    m = len(p)
    quotient = {x: x * m / (order.index(x) + 1) for x in p}
    want = {x: min(1.0, *(quotient[y] for y in p if y >= x)) for x in p}
    rows = [(k, x) for k, x in enumerate([*p, None])]
    for parts in (1, 7, 200):
        got = regression.adjusted(frame(spark, rows, "k int, p double"), parts=parts).collect()
        assert len(got) == len(rows)
        assert all(r["p_adjusted"] is None if r["p"] is None else r["p_adjusted"] == pytest.approx(want[r["p"]]) for r in got)


@pytest.mark.parametrize("metric", ["chebyshev", "haversine"])
def test_nearest_cell_against_all_pairs(spark, metric):
    rng = np.random.default_rng(4)
    cells = [(j, i, float(-2 + 0.3 * j), float(-92 + 0.3 * i)) for j in range(12) for i in range(12) if rng.random() < 0.6]
    points = [(f"s{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-5, 5, 40), rng.uniform(-97, -84, 40), strict=True))]
    got = {r["station"]: (r["j"], r["i"]) for r in joins.nearest_cell(frame(spark, points, "station string, lat double, lon double"), frame(spark, cells, "j int, i int, lat double, lon double"), metric).collect()}

    def far(a, b, c):
        lat, lon = abs(a - c[2]), abs(b - c[3])
        if metric == "chebyshev":
            return max(lat, lon)
        return 2 * math.asin(math.sqrt(math.sin(math.radians(lat) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c[2])) * math.sin(math.radians(lon) / 2) ** 2))

    for name, a, b in points:
        j, i = got[name]
        assert far(a, b, next(c for c in cells if c[:2] == (j, i))) == pytest.approx(min(far(a, b, c) for c in cells))
    assert joins.nearest_cell(frame(spark, [], "station string, lat double, lon double"), frame(spark, cells, "j int, i int, lat double, lon double")).count() == 0


def test_lines_and_polygons(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    lines = {"through": [(-1.0, 2.0), (5.0, 2.0)], "inside": [(1.0, 1.0), (2.0, 2.0)], "corner": [(-1.0, 1.0), (1.0, -1.0)], "outside": [(5.0, 5.0), (6.0, 9.0)], "beside": [(-1.0, -2.0), (9.0, -1.0)], "point": [(3.0, 3.0)], "edge": [(1.0, 0.0), (2.0, 0.0)], "around": [(-1.0, -1.0), (-1.0, 5.0), (5.0, 5.0)]}
    table = frame(spark, list(lines.items()), "name string, points array<struct<x: double, y: double>>")
    rings = frame(spark, [("a", square), ("b", [(x + 100, y) for x, y in square])], "id string, ring array<struct<x: double, y: double>>")
    for cell in (0.7, 50.0):
        assert sorted((r["name"], r["id"]) for r in joins.features_in_polygons(table, rings, cell).collect()) == [(n, "a") for n in ("corner", "edge", "inside", "point", "through")]


def test_attributes(spark):
    source = {"TITLE": "OUTPUT FROM WRF V4.1 MODEL", "MAP_PROJ_CHAR": "Mercator", "STAND_LON": "-85", "MOAD_CEN_LAT": "0", "TRUELAT1": "0", "TRUELAT2": "0", "pyproj_srs": "+proj=merc", "DX": "2000", "DY": "2000"}
    got = names.global_attributes(source, {"GRID_NX": 245}, "d02", "cape", "01-01-2024 00:00:00", {"TITLE": "own"})
    assert (got["WRF_VERSION"], got["DOMAIN"], got["NESTED"], got["GRID_NX"], got["TITLE"]) == ("WRF V4.1", "2", "YES", "245", "own")
    assert names.global_attributes(source, {}, "d01", "t2", "")["NESTED"] == "NO"
    both = spark.range(1).select(names.with_attributes(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', '3')")).alias("m")).first()["m"]
    assert both == {"a": "1", "b": "3"}


def test_raw_days(spark, tmp_path):
    import gzip

    for day, zipped in (("2022-04-01", True), ("2022-04-02", False), ("2022-04-03", False)):
        folder = tmp_path / day[:4] / day[:7] / day
        folder.mkdir(parents=True)
        content = f"content of {day}".encode()
        (folder / ("wrfpost_x.gz" if zipped else "wrfpost_x")).write_bytes(gzip.compress(content) if zipped else content)
        (folder / "other").write_bytes(b"no")
    got = files.raw_days(spark, f"file://{tmp_path}", "2022-04-01", "2022-04-02").orderBy("day").collect()
    assert [(str(r["day"]), bytes(r["content"]), r["path"].endswith("wrfpost_x")) for r in got] == [("2022-04-01", b"content of 2022-04-01", True), ("2022-04-02", b"content of 2022-04-02", True)]


def packed_short(path, records=5):
    """One record variable of two bytes a value, packed, whose records aren't padded; no other record variable."""
    name = lambda s: struct.pack(">i", len(s)) + s + b"\0" * (-len(s) % 4)
    number = lambda k, kind, fmt, v: name(k) + struct.pack(">ii", kind, 1) + struct.pack(fmt, v)
    body = lambda begin: (
        b"CDF\1" + struct.pack(">i", records) + struct.pack(">ii", 10, 3) + name(b"record") + struct.pack(">i", 0) + name(b"y") + struct.pack(">i", 1) + name(b"x") + struct.pack(">i", 3)
        + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + name(b"tp") + struct.pack(">iiii", 3, 0, 1, 2)
        + struct.pack(">ii", 12, 4) + number(b"scale_factor", 6, ">d", 0.5) + number(b"add_offset", 6, ">d", 10.0) + number(b"missing_value", 3, ">hxx", -7) + number(b"_FillValue", 3, ">hxx", -9)
        + struct.pack(">iii", 3, 8, begin)
    )
    head = body(len(body(0)))
    with open(path, "wb") as f:
        f.write(head)
        for k in range(records):
            f.write(struct.pack(">3h", k, -7, -9))


def test_packed_netcdf(spark, tmp_path):
    packed_short(f"{tmp_path}/p.nc")
    assert netcdf.Header(f"{tmp_path}/p.nc").read("tp", 2, 4).tolist() == [[[2, -7, -9]], [[3, -7, -9]]]
    classic(f"{tmp_path}/MM_d02km_d_2d_t2_2000.nc")
    netcdf.register(spark)
    first = spark.read.format("netcdf-classic").option("path", f"{tmp_path}/p.nc").load().where("i = 0 AND tp IS NOT NULL")
    assert first.columns == ["time", "level", "j", "i", "tp"]


def test_openers(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "MM").mkdir()
    classic(f"{base}/MM/MM_d02km_d_2d_t2_2000.nc")
    (tmp_path / "MM" / "MM").mkdir()
    grid = frame(spark, [(j, i, 1.0) for j in range(2) for i in range(2)], "j int, i int, hgt double")
    for place in (f"{base}/MM/MM_d02km_static_hgt.parquet", f"{base}/MM/MM/MM_d02km_static_hgt.parquet"):
        grid.write.parquet(f"file://{place}")
    assert files.open_elements(spark, year=2000, base=base).count() == 12
    by_elements = files.open_experiment(spark, year=2000, base=base, units="K", hgt=True)
    by_file = files.open_experiment_from_file(spark, f"{base}/MM/MM_d02km_d_2d_t2_2000.nc", "K", hgt=True)
    for e in (by_elements, by_file):
        assert e.name == "MM" and e.cube.variable == "t2" and e.cube.grid.count() == 4 and e.cube.df.count() == 12
    assert files.open_experiment(spark, year=2000, base=base, units="K").cube.grid is None


def classic(path, fixed=False):
    """A small file with records: time, y, x."""
    name = lambda s: struct.pack(">i", len(s)) + s + b"\0" * (-len(s) % 4)
    text = lambda k, v: name(k) + struct.pack(">ii", 2, len(v)) + v + b"\0" * (-len(v) % 4)
    body = lambda begin: (
        b"CDF\1" + struct.pack(">i", 3) + struct.pack(">ii", 10, 3) + name(b"time") + struct.pack(">i", 0) + name(b"south_north") + struct.pack(">i", 2) + name(b"west_east") + struct.pack(">i", 2)
        + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
        + name(b"time") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 12, 1) + text(b"units", b"hours since 2000-01-01 00:00") + struct.pack(">iii", 6, 8, begin)
        + name(b"t2") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 12, 1) + name(b"_FillValue") + struct.pack(">iif", 5, 1, -9.0) + struct.pack(">iii", 5, 16, begin + 8)
    )
    head = body(len(body(0)))
    with open(path, "wb") as f:
        f.write(head)
        for k in range(3):
            f.write(struct.pack(">d", 6.0 * k) + struct.pack(">4f", k, -9.0, math.nan, 1.5))


def test_classic_netcdf(spark, tmp_path):
    classic(f"{tmp_path}/a.nc")
    netcdf.register(spark)
    rows = spark.read.format("netcdf-classic").option("path", f"{tmp_path}/*.nc").option("variable", "t2").load().orderBy("time", "j", "i").collect()
    assert [r["t2"] for r in rows] == [0.0, None, None, 1.5, 1.0, None, None, 1.5, 2.0, None, None, 1.5]
    assert rows[-1]["time"] == TS(2000, 1, 1, 12) and (rows[1]["j"], rows[1]["i"]) == (0, 1)


def test_files_and_sinks(spark, tmp_path):
    with open(f"{tmp_path}/01_AWS-P_Junco_a_b.csv", "w") as f:
        f.write("datetime,T,RH\n2022-04-01 00:00:00,1.5,NaN\n2022-04-02 00:00:00,,2\n")
    got = files.stations_csv(spark, f"{tmp_path}/*.csv", ["T", "RH", "none"], "Pacific/Galapagos").orderBy("ts").collect()
    assert [(r["station"], r["ts"], r["T"], r["RH"]) for r in got] == [("Junco", TS(2022, 4, 1, 6), 1.5, None), ("Junco", TS(2022, 4, 2, 6), None, 2.0)]
    assert len(files.existing(spark, f"{tmp_path}/*.csv")) == 1
    with pytest.raises(FileNotFoundError):
        files.existing(spark, f"{tmp_path}/*.none")
    long = frame(spark, [(TS(2022, 1, 1), "a", 1.0), (TS(2022, 1, 1), "b", 2.0), (TS(2022, 1, 2), "b", 3.0)], "ts timestamp_ntz, station string, value double")
    sinks.write_wide_csv(long, f"{tmp_path}/wide", ["a", "b"])
    back = files.extracted_csv(spark, f"{tmp_path}/wide").where("value IS NOT NULL")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in long.collect()}
    cube = frame(spark, [(TS(2000, 1, 1), 0, 0, 1.0), (TS(2001, 1, 1), 0, 0, 2.0)], "time timestamp_ntz, j int, i int, t2 double")
    sinks.write_cube(cube, f"{tmp_path}/cube", "e1", "d", {"units": "K"})
    assert files.open_cube(spark, f"{tmp_path}/cube", ["t2"]).columns == ["experiment", "frequency", "time", "j", "i", "t2"]
    old, new = (frame(spark, [("e1", "units", v)], "experiment string, key string, value string") for v in ("K", "C"))
    assert [sinks.upsert_attributes(old, new, o).first()["value"] for o in (False, True)] == ["K", "C"]


def test_streaming_bins(spark, tmp_path):
    rows = [(k % 2, TS(2024, 1, 1 + k // 4, k % 24), float(k)) for k in range(40)]
    frame(spark, rows, "station int, ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("station int, ts timestamp, value double").parquet(f"{tmp_path}/in")
    resample.run_available(resample.binned(stream, "value", ["station"]), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.agg(F.sum("n")).first()[0] == sum(1 for _, ts, _ in rows if ts.day <= 7)


def test_specifications(spark):
    with pytest.raises(ValueError):
        trends.Spec("timeseries", ["v"], (10, 20), frequency="y")
    with pytest.raises(ValueError):
        trends.Spec("pie", ["v"], (10, 20))
    assert trends.Spec("trend", ["prcp"], (10, 20)).stem == "trend_hgt-0-2000_v-prcp_y-1980-2023"
    cube = model.Cube(frame(spark, [(TS(2000, 1, 1), 0, 0, 280.15)], "time timestamp_ntz, j int, i int, t2 double"), attributes={"VARNAME": "t2", "units": "k"})
    warm = cube.between("2000-01-01", "2000-12-31").convert_units()
    assert warm.df.first()["t2"] == pytest.approx(7.0) and warm.attributes["units"] == "degC"
    assert model.Experiment("e1", warm).names == ["t2", "T"]
    with pytest.raises(ValueError):
        model.Experiment("e1", model.Cube(cube.df))
    assert reduce.spatial_mean(cube.df, ["t2"]).count() == 1
