"""Jobs from NetCDF files to NetCDF files: periods put together, grids remapped, stations extracted."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.operators import regrid, select
from cubewind.sources import netcdf, sinks
from cubewind.sources.files import combine


def open_variable(spark: SparkSession, path: str, variable: str) -> DataFrame:
    netcdf.register(spark)
    df = spark.read.format("netcdf").option("path", path).option("variable", variable).load()
    return df if "level" in df.columns and _levels(path, variable) else df.drop("level")


def _levels(path: str, variable: str) -> bool:
    v = netcdf.opened(netcdf.first_of(path)).variables[variable]
    return len(v.shape) - ("time" in v.dims) == 3


def model_grid(spark: SparkSession, path: str) -> DataFrame:
    """j, i, lon, lat of the cells of a file, whose coordinates may be curves."""
    lon, lat = (open_variable(spark, path, c).select("j", "i", c) for c in ("lon", "lat"))
    return lon.join(lat, ["j", "i"])


def merge_period(spark: SparkSession, paths: Sequence[str], variable: str, start: str, end: str, out: str, units: str = "") -> None:
    """The files of a variable one after the other, without what lies outside of a period of whole days, as one file. Bounds reach
    the files: those and their chunks outside of the period aren't read."""
    cubes = [open_variable(spark, p, variable) for p in paths]
    sinks.write_netcdf(select.date_slice(combine(cubes), start, end), out, variable, units)


def remapped(cube: DataFrame, weights: DataFrame, variable: str) -> DataFrame:
    """A cube on a target of (j, i) cells by weights whose keys are tj and ti."""
    return regrid.remap(cube, weights, variable).withColumnsRenamed({"tj": "j", "ti": "i"})


def remap_file(spark: SparkSession, path: str, variable: str, xsize: int, ysize: int, xfirst: float, xinc: float, yfirst: float, yinc: float, cell: float, weights: DataFrame | None = None, overwrite: bool = False) -> str:
    """A file's variable on a regular grid of longitude and latitude, bilinearly, as <stem>_remapped.nc beside it or in its place.
    `weights` (of curvilinear_weights, written once) serve all files of a model grid; cell: degrees, a few steps of it."""
    target = regrid.lonlat_grid(spark, xsize, ysize, xfirst, xinc, yfirst, yinc).select(F.col("j").alias("tj"), F.col("i").alias("ti"), "lon", "lat")
    own = weights if weights is not None else regrid.curvilinear_weights(target, model_grid(spark, path), cell)
    stem, dot, kind = path.rpartition(".")
    out = f"{stem}_remapped{dot}{kind}"
    axes = {"lon": np.tile(xfirst + np.arange(xsize) * xinc, (ysize, 1)), "lat": np.repeat(yfirst + np.arange(ysize) * yinc, xsize).reshape(ysize, xsize)}
    sinks.write_netcdf(remapped(open_variable(spark, path, variable), own, variable), out, variable, coordinates=axes)
    if overwrite:
        os.replace(out, path)
    return path if overwrite else out


def extract_stations(spark: SparkSession, path: str, variable: str, stations: DataFrame, cell: float) -> DataFrame:
    """station, ts and value of a file's variable at stations (station, lon, lat), bilinearly on the model's own grid."""
    weights = regrid.curvilinear_weights(stations.select("station", "lon", "lat"), model_grid(spark, path), cell)
    return regrid.remap(open_variable(spark, path, variable), weights, variable).select("station", F.col("time").alias("ts"), F.col(variable).alias("value"))
