"""Elevation of a domain from the first source that has it."""

from __future__ import annotations

import glob

from pyspark.sql import DataFrame, SparkSession

from cubewind.operators import regrid, select
from cubewind.plans.file_jobs import model_grid
from cubewind.sources import files

#: Degrees around a box that are read of each kind of raster, and the product whose bound on the area holds
BUFFERS = {"SRTM3": 0.05, "GMTED2010": 1.0}
#: Degrees; finer rasters count as SRTM's, others as GMTED's
FINE = 0.05


def elevation(spark: SparkSession, lon: tuple[float, float], lat: tuple[float, float], resolution_m: float, domain: int, statics: dict[str, tuple[str, str]] | None = None, rasters: dict[float, str] | None = None) -> tuple[str, DataFrame]:
    """The source and lon, lat, elevation of a domain (from 0). statics: files of height and land mask of the model by domain (d01,
    d02); rasters: files by their resolution in degrees. Sources are tried in the order of regrid.elevation_source: the model's own
    fields, a fine raster if the resolution asks for one and the box isn't too large for it, a coarse one, and synthetic."""
    area = (lon[1] - lon[0]) * (lat[1] - lat[0])
    for source in regrid.elevation_source(resolution_m, domain):
        kind, _, which = source.partition(":")
        if kind == "static" and all(glob.glob(p) for p in (statics or {}).get(which, ("",))):
            height, land = statics[which]
            own = regrid.static_elevation(files.open_file(spark, height, "hgt").select("j", "i", "hgt"), files.open_file(spark, land, "landmask").select("j", "i", "landmask"))
            return source, own.join(model_grid(spark, height), ["j", "i"]).select("lon", "lat", "elevation")
        if kind in BUFFERS:
            fits = {r: p for r, p in (rasters or {}).items() if (r < FINE) == (kind == "SRTM3") and glob.glob(p)}
            if fits and (kind != "SRTM3" or select.download_allowed(area, kind)):
                return source, files.open_elevation(spark, fits, float(which or resolution_m / 111000), lon, lat, BUFFERS[kind])
        if kind == "synthetic":
            return source, regrid.synthetic_elevation(regrid.linspace_grid(spark, lon, lat, 200, 200), lon, lat).select("lon", "lat", "elevation")
    raise ValueError("no source of elevation")
