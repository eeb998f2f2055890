
import datetime
import os

import numpy as np
import pytest

from cubewind.functions import names
from cubewind.model import primary_variable
from cubewind.plans import file_jobs
from cubewind.sources import files, netcdf, sinks
from tests.hdf5_files import Builder
from tests.test_grids import rotated

TS = datetime.datetime


def model_file(path, days=6, start="2000-01-01", units="days", nj=9, ni=12):
    """A NetCDF-4 file on a turned grid; values are a plane that rises with time."""
    cells = {(j, i): (x, y) for j, i, x, y in rotated(nj, ni)}
    lon, lat = (np.array([[cells[j, i][c] for i in range(ni)] for j in range(nj)], "<f8") for c in (0, 1))
    b = Builder(True)
    b.array("time", np.arange(days, dtype="<f8"), {"units": f"{units} since {start} 00:00:00"})
    b.array("south_north", np.arange(nj, dtype="<f4"))
    b.array("west_east", np.arange(ni, dtype="<f4"))
    b.array("lon", lon, {"DIMENSION_LIST": ["south_north", "west_east"]})
    b.array("lat", lat, {"DIMENSION_LIST": ["south_north", "west_east"]})
    x = (2 * lon - 3 * lat)[None] + np.arange(days)[:, None, None]
    b.array("t2", x.astype("<f8"), {"units": "K", "DIMENSION_LIST": ["time", "south_north", "west_east"]}, chunks=(2, 5, 5))
    b.write(path)
    return lon, lat


def test_k03_g05_remapped_file(spark, tmp_path):
    lon, lat = model_file(f"{tmp_path}/MM_d02km_d_2d_t2_2000.nc")
    out = file_jobs.remap_file(spark, f"{tmp_path}/MM_d02km_d_2d_t2_2000.nc", "t2", 6, 5, -90.95, 0.05, -0.95, 0.06, 0.2)
    assert os.path.basename(out) == "MM_d02km_d_2d_t2_2000_remapped.nc"
    rows = file_jobs.open_variable(spark, out, "t2").collect()
    assert len(rows) == 6 * 30 and "level" not in rows[0].asDict()
    fine = [r for r in rows if r["t2"] is not None]
    assert 0 < len(fine) < len(rows)
    for r in fine:
        day = (r["time"] - TS(2000, 1, 1)).days
        assert r["t2"] == pytest.approx(2 * (-90.95 + 0.05 * r["i"]) - 3 * (-0.95 + 0.06 * r["j"]) + day, abs=1e-4)
    assert netcdf.Header(out).read("lon")[0].tolist() == pytest.approx([-90.95 + 0.05 * k for k in range(6)])
    same = file_jobs.remap_file(spark, f"{tmp_path}/MM_d02km_d_2d_t2_2000.nc", "t2", 6, 5, -90.95, 0.05, -0.95, 0.06, 0.2, overwrite=True)
    assert sorted(os.listdir(tmp_path)) == ["MM_d02km_d_2d_t2_2000.nc"] and isinstance(netcdf.opened(same), netcdf.Header)


def test_g06_j08_stations_of_a_curvilinear_file(spark, tmp_path):
    lon, lat = model_file(f"{tmp_path}/a.nc")
    stations = spark.createDataFrame([("in", float(lon[2:4, 3:5].mean()), float(lat[2:4, 3:5].mean())), ("out", 0.0, 0.0)], "station string, lon double, lat double")
    got = sorted((r["station"], r["ts"], r["value"]) for r in file_jobs.extract_stations(spark, f"{tmp_path}/a.nc", "t2", stations, 0.2).collect())
    want = 2 * lon[2:4, 3:5].mean() - 3 * lat[2:4, 3:5].mean()
    assert [(s, t) for s, t, _ in got] == [(s, TS(2000, 1, 1) + datetime.timedelta(days=k)) for s in ("in", "out") for k in range(6)]
    assert [v for s, _, v in got if s == "in"] == pytest.approx([want + k for k in range(6)]) and all(v is None for s, _, v in got if s == "out")


def test_k03_merged_period(spark, tmp_path):
    model_file(f"{tmp_path}/x_2000.nc", 366, "2000-01-01", nj=3, ni=3)
    model_file(f"{tmp_path}/x_2001.nc", 365, "2001-01-01", nj=3, ni=3)
    file_jobs.merge_period(spark, [f"{tmp_path}/x_2000.nc", f"{tmp_path}/x_2001.nc"], "t2", "2000-12-30", "2001-01-02", f"{tmp_path}/period.nc", "K")
    got = file_jobs.open_variable(spark, f"{tmp_path}/period.nc", "t2").collect()
    assert sorted({r["time"] for r in got}) == [TS(2000, 12, 30), TS(2000, 12, 31), TS(2001, 1, 1), TS(2001, 1, 2)] and len(got) == 4 * 9
    assert netcdf.Header(f"{tmp_path}/period.nc").variables["t2"].attributes["units"] == "K"


def test_s02_paths():
    assert files.path_of("MM", "t2", 2000, base="/b") == "/b/MM/MM_d02km_d_2d_t2_2000.nc"
    assert files.path_of("MM", "hgt", 2000, base="/b") == "/b/MM/MM_d02km_static_hgt.nc"
    assert files.elements_of("/b/MM/MM_d02km_d_2d_t2_2000.nc")["variable"] == "t2"


def test_s03_s05_open_by_elements(spark, tmp_path):
    os.makedirs(f"{tmp_path}/MM")
    model_file(f"{tmp_path}/MM/MM_d02km_d_2d_t2_2000.nc")
    assert files.open_elements(spark, year=2000, base=str(tmp_path)).count() == 6 * 9 * 12
    e = files.open_experiment(spark, year=2000, base=str(tmp_path), units="K")
    assert e.name == "MM" and e.cube.variable == "t2" and e.cube.df.where("time >= '2000-01-05'").count() == 2 * 9 * 12


def test_s04_experiment_from_a_file(spark, tmp_path):
    os.makedirs(f"{tmp_path}/MM/MM")
    model_file(f"{tmp_path}/MM/E1_d02km_d_2d_t2_2000.nc")
    b = Builder(False)
    b.array("south_north", np.arange(9, dtype="<f4"))
    b.array("west_east", np.arange(12, dtype="<f4"))
    b.array("hgt", np.arange(108, dtype="<f4").reshape(9, 12), {"DIMENSION_LIST": ["south_north", "west_east"]})
    b.write(files.static_path(f"{tmp_path}/MM/E1_d02km_d_2d_t2_2000.nc", "hgt"))
    e = files.open_experiment_from_file(spark, f"{tmp_path}/MM/E1_d02km_d_2d_t2_2000.nc", "K", hgt=True)
    assert e.name == "E1" and sorted(r["hgt"] for r in e.cube.grid.collect()) == [float(k) for k in range(108)]


def test_s07_s08_s10_station_files(spark, tmp_path):
    for name, rows in (("01_AWS-P_El_Junco_2022_x", "2022-04-01 00:00:00,1.5,nan\n"), ("02_AWS-P_Santa_Rosa_2022_x", "2022-04-01 00:00:00,2.5,7\n"), ("other", "2022-04-01 00:00:00,9,9\n")):
        (tmp_path / f"{name}.csv").write_text("datetime,PCP_tot_bucket,T\n" + rows)
    got = {r["station"]: r for r in files.stations_csv(spark, f"{tmp_path}/??_AWS-P*.csv", local_zone="Pacific/Galapagos").collect()}
    assert set(got) == {"Junco", "Rosa"} and got["Junco"]["ts"] == TS(2022, 4, 1, 6) and got["Junco"]["T"] is None and got["Rosa"]["T"] == 7.0
    plain = files.stations_csv(spark, f"{tmp_path}/??_AWS-P*.csv", ["PCP_tot_bucket", "unknown"])
    assert plain.columns == ["station", "ts", "PCP_tot_bucket"] and plain.first()["ts"] == TS(2022, 4, 1)


def test_s09_k04_wide_files(spark, tmp_path):
    df = spark.createDataFrame([("a", TS(2022, 4, 1), 1.0), ("b", TS(2022, 4, 1), 2.0), ("a", TS(2022, 4, 2), 3.0)], "station string, ts timestamp_ntz, value double")
    sinks.write_wide_csv(df, f"{tmp_path}/w.csv", ["a", "b"])
    back = sorted((r["station"], r["ts"], r["value"]) for r in files.extracted_csv(spark, f"{tmp_path}/w.csv").where("value IS NOT NULL").collect())
    assert back == [("a", TS(2022, 4, 1), 1.0), ("a", TS(2022, 4, 2), 3.0), ("b", TS(2022, 4, 1), 2.0)]


def test_s11_s12_found_files(spark, tmp_path):
    for name in ("MM_d02km_d_2d_t2_2000.nc", "MM_d02km_m_2d_t2_2000.nc", "MM_d02km_d_3d_t2_2000.nc", "MM_d02km_d_2d_rh_2001.nc"):
        (tmp_path / name).write_bytes(b"")
    found = files.existing(spark, f"{tmp_path}/*.nc")
    assert len(found) == 4
    with pytest.raises(FileNotFoundError):
        files.existing(spark, f"{tmp_path}/*.none")
    assert {k: os.path.basename(v) for k, v in files.variable_files(found, 2000, ["t2", "rh"]).items()} == {"t2": "MM_d02km_m_2d_t2_2000.nc"}


def test_s13_index_file(spark, tmp_path):
    (tmp_path / "i.csv").write_text("time,value\n1979-12-01,1.0\n1980-01-01,2.0\n2023-12-31,\n2024-01-01,4.0\n")
    assert [(str(r["time"]), r["value"]) for r in files.index_csv(spark, f"{tmp_path}/i.csv").orderBy("time").collect()] == [("1980-01-01", 2.0), ("2023-12-31", None)]


def test_p02_primary_variable(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 4.0)], "j int, i int, a double, b double")
    assert primary_variable(df, {"VARNAME": "a"}) == "a" and primary_variable(df) == "b"


def test_p08_k02_attributes_of_a_file(spark, tmp_path):
    source = {"TITLE": "OUTPUT FROM WRF V4.1 MODEL", "MAP_PROJ_CHAR": "Mercator", "STAND_LON": "-90", "MOAD_CEN_LAT": "0", "TRUELAT1": "0", "TRUELAT2": "0", "pyproj_srs": "+proj=merc", "DX": "2000", "DY": "2000"}
    own = names.global_attributes(source, {"GRID_NX": 245}, "d02", "t2", "2024-01-01", {"TITLE": "own"}, notes="some notes")
    assert own["NESTED"] == "YES" and own["DATA_NOTES"] == "some notes" and own["TITLE"] == "own" and own["GRID_NX"] == "245"
    assert "DATA_NOTES" not in names.global_attributes(source, {}, "d01", "t2", "2024-01-01")
    df = spark.createDataFrame([(TS(2000, 1, 1), 0, 0, 1.0)], "time timestamp_ntz, j int, i int, t2 double")
    sinks.write_netcdf(df, f"{tmp_path}/a.nc", "t2", "K", own)
    head = netcdf.Header(f"{tmp_path}/a.nc")
    assert head.attributes["NESTED"] == "YES" and head.attributes["PYPROJ_SRS"] == "+proj=merc" and head.variables["time"].attributes["calendar"] == "standard"


def test_s17_s18_s20_s21_elevation_from_the_first_source(spark, tmp_path):
    from cubewind.plans.elevation import elevation
    from tests.test_vectors_rasters import tiff

    lon, lat = model_grid_files(tmp_path)
    x = np.arange(40 * 50, dtype="f4").reshape(40, 50)
    tiff(f"{tmp_path}/fine.tif", x, step=0.01, tile=(16, 16))
    b = Builder(False)
    b.array("latitude", np.linspace(1, -2, 61))
    b.array("longitude", np.linspace(-93, -90, 61))
    b.array("z", np.arange(61 * 61, dtype="<f4").reshape(61, 61), {"DIMENSION_LIST": ["latitude", "longitude"]}, (16, 16))
    b.write(f"{tmp_path}/coarse.nc")
    statics = {"d02": (f"{tmp_path}/hgt.nc", f"{tmp_path}/landmask.nc")}
    rasters = {0.01: f"{tmp_path}/fine.tif", 0.05: f"{tmp_path}/coarse.nc"}
    box = ((-91.95, -91.6), (0.7, 0.95))
    source, df = elevation(spark, *box, 2000, 1, statics, rasters)
    assert source == "static:d02" and df.where("elevation = 0").count() == 54 and df.count() == 108
    source, df = elevation(spark, *box, 1000, 2, statics, rasters)
    assert source == "SRTM3" and df.count() == sum(-92.0 <= -92 + 0.01 * (k + 0.5) <= -91.55 for k in range(50)) * sum(0.65 <= 1 - 0.01 * (k + 0.5) <= 1.0 for k in range(40))
    source, df = elevation(spark, *box, 100_000, 2, statics, rasters)
    rows = df.collect()
    assert source == "GMTED2010:0.0625" and rows and all(-92.95 - 1e-9 <= r["lon"] <= -90.6 + 1e-9 and -0.3 - 1e-9 <= r["lat"] <= 1.95 for r in rows)
    for r in rows:
        assert r["elevation"] == 61 * round((1 - r["lat"]) / 0.05) + round((r["lon"] + 93) / 0.05)
    assert len(rows) == sum(box[0][0] - 1.0 <= v <= box[0][1] + 1.0 for v in np.linspace(-93, -90, 61)) * sum(box[1][0] - 1.0 <= v for v in np.linspace(1, -2, 61))
    source, df = elevation(spark, *box, 1000, 2, statics, {0.05: f"{tmp_path}/none.nc"})
    assert source == "synthetic" and df.count() == 40000
    assert elevation(spark, (-100, -80), (-10, 10), 1000, 2, None, rasters)[0] == "GMTED2010:0.0625"  # too large for the fine one


def model_grid_files(tmp_path):
    cells = {(j, i): (x, y) for j, i, x, y in rotated(9, 12)}
    lon, lat = (np.array([[cells[j, i][c] for i in range(12)] for j in range(9)], "<f8") for c in (0, 1))
    for name, x in (("hgt", np.full((9, 12), 7.0, "<f4")), ("landmask", (np.arange(108).reshape(9, 12) % 2).astype("<f4"))):
        b = Builder(True)
        b.array("south_north", np.arange(9, dtype="<f4"))
        b.array("west_east", np.arange(12, dtype="<f4"))
        for n, v in (("lon", lon), ("lat", lat), (name, x)):
            b.array(n, v, {"DIMENSION_LIST": ["south_north", "west_east"]})
        b.write(f"{tmp_path}/{name}.nc")
    return lon, lat
