"""NetCDF-4 and classic files: reading by chunks, push-down, and writing."""

import datetime
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubewind.sources import hdf5, netcdf, sinks
from tests.hdf5_files import Builder

START = np.datetime64("2000-01-01T00:00:00")


def cube(nt=10, nk=3, nj=5, ni=7):
    x = np.arange(nt * nk * nj * ni, dtype="<f4").reshape(nt, nk, nj, ni)
    x[1, 1, 1, 1] = -9
    x[2, 0, 0, 0] = np.nan
    return x


def written(path, modern, x, chunks=(4, 2, 3, 4), **more):
    b = Builder(modern)
    nt, nk, nj, ni = x.shape
    b.array("time", np.arange(nt, dtype="<f8") * 6, {"units": "hour since 2000-01-01 00:00:00", "calendar": "standard"})
    b.array("pressure", np.array([1000, 850, 500][:nk], "<i4"))
    b.array("south_north", np.arange(nj, dtype="<f4"))
    b.array("west_east", np.arange(ni, dtype=">f4"))
    b.array("lat", np.ones((nj, ni), "<f4"), {"DIMENSION_LIST": ["south_north", "west_east"]})
    own = {"units": "K", "_FillValue": np.float32(-9), "long_name": "temperature", "agg_method": "mean", "coordinates": "lon lat", "DIMENSION_LIST": ["time", "pressure", "south_north", "west_east"]}
    b.array("tk", x, own, chunks, **more)
    b.write(path, {"experiment": "MM", "year": np.int32(2000)})


@pytest.mark.parametrize("modern", [False, True])
def test_hdf5_structure(tmp_path, modern):
    x = cube()
    written(f"{tmp_path}/a.nc", modern, x)
    f = hdf5.File(f"{tmp_path}/a.nc")
    assert list(f.variables)[-1] == ("west_east" if not modern else "tk") and f.attributes["experiment"] == "MM" and f.attributes["year"].tolist() == [2000]
    v = f.variables["tk"]
    assert v.dims == ("time", "pressure", "south_north", "west_east") and v.chunks == (4, 2, 3, 4) and v.attributes["units"] == "K" and v.attributes["_FillValue"].tolist() == [-9]
    assert f.variables["lat"].dims == ("south_north", "west_east") and f.read("west_east").tolist() == [0, 1, 2, 3, 4, 5, 6]
    assert np.array_equal(f.read("tk"), x, equal_nan=True)
    f.opened = 0
    assert np.array_equal(f.read("tk", [(5, 7), (2, 3), (0, 3), (3, 6)]), x[5:7, 2:3, 0:3, 3:6]) and f.opened == 2
    assert f.read("tk", [(3, 3), (0, 3), (0, 5), (0, 7)]).shape == (0, 3, 5, 7)


@pytest.mark.parametrize("modern", [False, True])
def test_hdf5_missing_chunks_and_plain_arrays(tmp_path, modern):
    x = np.arange(60, dtype="<f8").reshape(6, 10)
    b = Builder(modern)
    b.array("a", x, chunks=(2, 4), deflate=False, skip={(2, 4)}, fill=-1.5)
    b.array("b", x.astype(">i2"))
    b.array("c", x, chunks=(6, 10))
    b.write(f"{tmp_path}/x.h5")
    f = hdf5.File(f"{tmp_path}/x.h5")
    want = x.copy()
    want[2:4, 4:8] = -1.5
    assert np.array_equal(f.read("a"), want) and np.array_equal(f.read("b", [(1, 4), (2, 9)]), x[1:4, 2:9]) and np.array_equal(f.read("c"), x)
    with pytest.raises(ValueError, match="isn't an HDF5 file"):
        (tmp_path / "y").write_bytes(b"nothing of the kind")
        hdf5.File(f"{tmp_path}/y")


def expected(x, at=START):
    return sorted(
        (at + np.timedelta64(6 * t, "h"), [1000, 850, 500][k], j, i, None if x[t, k, j, i] == -9 or np.isnan(x[t, k, j, i]) else float(x[t, k, j, i]))
        for t in range(x.shape[0]) for k in range(x.shape[1]) for j in range(x.shape[2]) for i in range(x.shape[3])
    )


@pytest.mark.parametrize("modern", [False, True])
def test_chunked_file_is_read_by_tasks(spark, tmp_path, modern):
    x = cube()
    written(f"{tmp_path}/MM_2000.nc", modern, x)
    netcdf.register(spark)
    reader = netcdf.GridReader([f"{tmp_path}/MM_2000.nc"], "tk", part_bytes=1)
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 4), (4, 8), (8, 10)]
    df = spark.read.format("netcdf").option("path", f"{tmp_path}/*.nc").option("variable", "tk").load()
    key = lambda r: tuple((0, 0) if c is None else (1, c) for c in r)
    got = sorted(((np.datetime64(r["time"]), r["level"], r["j"], r["i"], r["tk"]) for r in df.collect()), key=key)
    assert got == sorted(expected(x), key=key)


def test_bounds_are_pushed_down(spark, tmp_path, monkeypatch):
    x = cube(nt=40)
    written(f"{tmp_path}/a.nc", True, x)
    netcdf.register(spark)
    df = spark.read.format("netcdf").option("path", f"{tmp_path}/a.nc").option("variable", "tk").load()
    some = df.where("time >= timestamp_ntz'2000-01-03 00:00:00' AND time < timestamp_ntz'2000-01-04 00:00:00' AND level = 500 AND j > 2 AND i IN (4, 5)")
    got = sorted((r["j"], r["i"], r["tk"]) for r in some.collect())
    assert got == sorted((j, i, float(x[t, 2, j, i])) for t in range(8, 12) for j in (3, 4) for i in (4, 5))
    # the same bounds in this process: partitions and opened chunks
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = netcdf.GridReader([f"{tmp_path}/a.nc"], "tk", part_bytes=1)
    bounds = [GreaterThanOrEqual(("time",), datetime.datetime(2000, 1, 3)), LessThan(("time",), datetime.datetime(2000, 1, 3, 23)), EqualTo(("level",), 500), EqualTo(("j",), 4)]
    assert list(reader.pushFilters(bounds)) == bounds
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(8, 12)]
    counted = []
    monkeypatch.setattr(netcdf, "opened", lambda p: counted.append(hdf5.File(p)) or counted[-1])
    assert sum(b.num_rows for b in reader.read(parts[0])) == 4 * 7
    assert counted[0].opened == 2  # of 10 * 2 * 2 * 2 chunks
    none = netcdf.GridReader([f"{tmp_path}/a.nc"], "tk")
    list(none.pushFilters([EqualTo(("time",), datetime.datetime(1999, 1, 1))]))
    assert none.partitions() == []


def test_written_file_is_read_back(spark, tmp_path):
    x = cube()
    written(f"{tmp_path}/a.nc", True, x)
    netcdf.register(spark)
    df = spark.read.format("netcdf").option("path", f"{tmp_path}/a.nc").option("variable", "tk").load().where("NOT (j = 0 AND i = 3)").repartition(5)
    out = f"{tmp_path}/out/b.nc"
    lat = np.arange(35, dtype=float).reshape(5, 7)
    sinks.write_netcdf(df, out, "tk", "K", {"experiment": "MM"}, {"lat": lat, "lon": -lat})
    back = spark.read.format("netcdf").option("path", out).option("variable", "tk").load()
    assert back.count() == 10 * 3 * 35
    both = back.alias("b").join(df.alias("a"), ["time", "level", "j", "i"], "left")
    assert both.where("NOT (a.tk <=> b.tk)").count() == 0 and both.where("b.tk IS NOT NULL").count() == df.where("tk IS NOT NULL").count()
    head = netcdf.Header(out)
    assert head.attributes["experiment"] == "MM" and head.variables["tk"].attributes["units"] == "K" and head.variables["tk"].attributes["coordinates"] == "lon lat"
    assert np.array_equal(head.read("lat"), lat) and head.variables["tk"].dims == ("time", "pressure", "south_north", "west_east") and os.listdir(f"{tmp_path}/out") == ["b.nc"]
    # levels of a classic file are read by their bounds, too
    assert [r["tk"] for r in back.where("level = 850 AND j = 1 AND i = 2").orderBy("time").collect()] == [float(x[t, 1, 1, 2]) for t in range(10)]
    two = df.where("level = 850").drop("level")
    sinks.write_netcdf(two, f"{tmp_path}/out/c.nc", "tk", kind="f8")
    again = spark.read.format("netcdf-classic").option("path", f"{tmp_path}/out/c.nc").load()
    assert again.where("tk IS NOT NULL").count() == two.where("tk IS NOT NULL").count() and again.where("level IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_netcdf(two, f"{tmp_path}/out/c.nc", "tk", mode="append")


def test_failed_write_leaves_no_file(spark, tmp_path):
    df = spark.range(20).select(F.expr("timestamp_ntz'2000-01-01 00:00:00' + make_interval(0, 0, 0, int(id), 0, 0, 0)").alias("time"), F.lit(0).alias("j"), F.lit(0).alias("i"), F.when(F.col("id") < 15, 1.0).otherwise(F.raise_error(F.lit("broken")).cast("double")).alias("v"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_netcdf(df, f"{tmp_path}/b.nc", "v")
    assert glob.glob(f"{tmp_path}/*") + glob.glob(f"{tmp_path}/.*") == []


def test_no_rows_and_repeated_cells(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2000, 1, 1), 0, 0, 1.0), (datetime.datetime(2000, 1, 1), 0, 0, 1.0), (None, 0, 1, 2.0), (datetime.datetime(2000, 1, 2), None, 1, 2.0)], "time timestamp_ntz, j int, i int, v double")
    sinks.write_netcdf(rows, f"{tmp_path}/a.nc", "v")
    netcdf.register(spark)
    got = spark.read.format("netcdf").option("path", f"{tmp_path}/a.nc").load().orderBy("time", "i").collect()
    assert [(r["i"], r["v"]) for r in got] == [(0, 1.0), (1, None), (0, None), (1, None)]
    sinks.write_netcdf(rows.limit(0), f"{tmp_path}/none.nc", "v")
    assert spark.read.format("netcdf").option("path", f"{tmp_path}/none.nc").load().count() == 0
