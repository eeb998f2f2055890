"""Where files are, and reading them as tidy frames."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.functions.names import STATIC
from cubewind.model import Cube, Experiment
from cubewind.operators.regrid import nearest_resolution
from cubewind.operators.select import box
from cubewind.operators.series import calendar_spine
from cubewind.sources import geotiff, netcdf, shapefile


def path_of(experiment: str, variable: str, year: int | None = None, domain: str = "d02km", dimensions: str = "2d", frequency: str = "d", base: str = "") -> str:
    """File of a variable, in the folder of its experiment; static fields have no frequency, dimensions or year, merged periods
    no year."""
    parts = [experiment, domain, "static", variable] if variable in STATIC else [experiment, domain, frequency, dimensions, variable, *([str(year)] if year else [])]
    return "/".join(x for x in (base.rstrip("/"), experiment, "_".join(parts) + ".nc") if x)


_NAME = re.compile(r"(?P<experiment>[^_/]+)_(?P<domain>d\d+\w*?)_(?:static_(?P<static>\w+?)|(?P<frequency>[ymdh])_(?P<dimensions>2d|3d_press|3d)_(?P<variable>\w+?)(?:_(?P<year>\d{4}))?)\.\w+$")


def elements_of(path: str) -> dict[str, str | None]:
    """The inverse of path_of."""
    m = _NAME.search(path)
    if not m:
        raise ValueError(f"not a file name of an experiment: {path}")
    d = m.groupdict()
    return {k: d[k] for k in ("experiment", "domain", "frequency", "dimensions", "year")} | {"variable": d["variable"] or d["static"]}


def static_path(path: str, variable: str) -> str:
    """The static file for an experiment's file: that of the reference run in its folder beside the file, whatever the
    experiment and domain."""
    return path_of("MM", variable, base="/".join(path.split("/")[:-1]))


def existing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, through the file system that Spark uses; an error if there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = sorted(s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or ())
    if not found:
        raise FileNotFoundError(pattern)
    return found


def variable_files(paths: Sequence[str], year: int, variables: Sequence[str]) -> dict[str, str]:
    """The last file of each variable that is named with it, is two-dimensional and of the year."""
    own = [p for p in paths if re.search(rf"_[dmy]_2d_.*_{year}\.nc", p)]
    return {v: [p for p in own if f"_{v}_" in p][-1] for v in variables if any(f"_{v}_" in p for p in own)}


def open_cube(spark: SparkSession, path: str, variables: Sequence[str] | None = None) -> DataFrame:
    """A converted cube; only the columns that are asked for are read. Auxiliary bounds are left out."""
    df = spark.read.parquet(path).drop("bnds")
    keys = [c for c in ("experiment", "frequency", "time", "level", "j", "i") if c in df.columns]
    return df.select(*keys, *variables) if variables else df


def open_elements(spark: SparkSession, experiment: str = "MM", variable: str = "t2", year: int | None = 2022, domain: str = "d02km", dimensions: str = "2d", frequency: str = "d", base: str = "") -> DataFrame:
    """The cube of a variable by the elements of its path."""
    return open_file(spark, path_of(experiment, variable, year, domain, dimensions, frequency, base), variable)


def open_file(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """A cube or static field from a NetCDF file, or from the Parquet that it was converted to, beside it."""
    parquet = path.removesuffix(".nc") + ".parquet"
    try:
        return open_cube(spark, parquet)
    except AnalysisException:
        netcdf.register(spark)
        reader = spark.read.format("netcdf").option("path", path)
        return (reader.option("variable", variable) if variable else reader).load()


def open_experiment_from_file(spark: SparkSession, path: str, units: str, hgt: bool = False, landmask: bool = False) -> Experiment:
    """An experiment from a file, with the static fields of the reference run if they are asked for."""
    e = elements_of(path)
    return _experiment(spark, path, e, units, {v: static_path(path, v) for v, asked in (("hgt", hgt), ("landmask", landmask)) if asked})


def open_experiment(spark: SparkSession, experiment: str = "MM", variable: str = "t2", year: int | None = 2022, domain: str = "d02km", dimensions: str = "2d", frequency: str = "d", base: str = "", units: str = "", hgt: bool = False, landmask: bool = False) -> Experiment:
    """An experiment by the elements of its path, with its own static fields if they are asked for."""
    path = path_of(experiment, variable, year, domain, dimensions, frequency, base)
    statics = {v: path_of(experiment, v, domain=domain, base=base) for v, asked in (("hgt", hgt), ("landmask", landmask)) if asked}
    return _experiment(spark, path, elements_of(path), units, statics)


def _experiment(spark: SparkSession, path: str, elements: dict[str, str | None], units: str, statics: dict[str, str]) -> Experiment:
    grid = None
    for name, file in statics.items():
        field = open_file(spark, file, name).select("j", "i", name)
        grid = field if grid is None else grid.join(field, ["j", "i"])
    attributes = {"VARNAME": elements["variable"], "units": units, "experiment": elements["experiment"], "frequency": elements["frequency"] or ""}
    return Experiment(elements["experiment"], Cube(open_file(spark, path, elements["variable"]), grid, attributes))


def raw_days(spark: SparkSession, base: str, start: str, end: str, pattern: str = "wrfpost*") -> DataFrame:
    """day, path, content of the raw output that lies in folders of year, month and day; compressed files are opened. One
    file is one row, so tasks read and write whole files."""
    days = [r["day"].isoformat() for r in calendar_spine(spark, start, end).orderBy("day").collect()]  # a period of days
    folders = [f"{base.rstrip('/')}/{d[:4]}/{d[:7]}/{d}" for d in days]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folders)
    first = raw.select(F.to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/[^/]+$", 1)).alias("day"), "path", "content")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                path, content = b.column("path")[k].as_py(), b.column("content")[k].as_py()
                zipped = path.endswith(".gz")
                row = [b.column("day").slice(k, 1), pa.array([path.removesuffix(".gz")]), pa.array([gzip.decompress(content) if zipped else content], pa.binary())]
                yield pa.record_batch(row, names=["day", "path", "content"])

    return first.mapInArrow(opened, "day date, path string, content binary")


_AXES = {"lat": ("lat", "latitude", "y"), "lon": ("lon", "longitude", "x")}


def open_raster(spark: SparkSession, path: str, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """lon, lat and elevation of a raster inside a box: a GeoTIFF, or a NetCDF file whose variable is elevation, z or the first on
    two axes, with axes by their usual names, either way up. Only tiles, or rows and columns of chunks, that meet the box are read."""
    if not path.endswith((".nc", ".nc4")):
        geotiff.register(spark)
        return box(spark.read.format("geotiff").option("path", path).load(), lon, lat, 0.0).select("lon", "lat", F.col("value").alias("elevation"))
    file = netcdf.opened(path)
    flat = [v.name for v in file.variables.values() if len(v.shape) - ("time" in v.dims) == 2]
    variable = next((v for v in ("elevation", "z") if v in flat), flat[0])
    axes = {c: next(netcdf.values(file, n).astype(float) for n in names if n in file.variables and len(file.variables[n].shape) == 1) for c, names in _AXES.items()}  # a number per row or column
    netcdf.register(spark)
    df = spark.read.format("netcdf").option("path", path).option("variable", variable).load()
    for place, (c, (low, high)) in (("j", ("lat", lat)), ("i", ("lon", lon))):
        inside = [(k, float(x)) for k, x in enumerate(axes[c]) if low <= x <= high]
        df = df.where(F.col(place).between(inside[0][0], inside[-1][0]) if inside else F.lit(False))
        df = df.join(F.broadcast(spark.createDataFrame(inside, f"{place} int, {c} double")), place)  # an axis of the box
    return df.select("lon", "lat", F.col(variable).alias("elevation"))


def open_elevation(spark: SparkSession, rasters: dict[float, str], wanted: float, lon: tuple[float, float], lat: tuple[float, float], buffer: float = 1.0) -> DataFrame:
    """lon, lat and elevation around a box from the raster (by resolution in degrees) whose resolution is nearest to the wanted
    one. Only tiles that meet the box and its buffer are read."""
    return open_raster(spark, nearest_resolution(rasters, wanted), (lon[0] - buffer, lon[1] + buffer), (lat[0] - buffer, lat[1] + buffer))


def open_shapes(spark: SparkSession, path: str, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None) -> DataFrame:
    """Shapes of a shapefile as id, rings (or pieces of lines) and properties; of a box, those whose own box meets it."""
    shapefile.register(spark)
    df = spark.read.format("shapefile").option("path", path).load()
    if lon and lat:
        df = df.where((F.col("x_min") <= lon[1]) & (F.col("x_max") >= lon[0]) & (F.col("y_min") <= lat[1]) & (F.col("y_max") >= lat[0]))
    return df.select("id", "kind", F.col("parts").alias("rings"), "properties")


def combine(frames: Sequence[DataFrame], sort: bool = False) -> DataFrame:
    """One after the other, without removal of repetitions."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy("time") if sort else out


def stations_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, local_zone: str | None = None) -> DataFrame:
    """station, ts and sensors of station files (`NN_AWS-P..._name_x_y.csv`); the station is the third token from the end."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    name = F.element_at(F.split(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1), "_"), -3)
    ts = F.col("datetime").cast("timestamp_ntz")
    if local_zone:
        ts = F.convert_timezone(F.lit(local_zone), F.lit("UTC"), ts)
    sensors = [c for c in (columns or df.columns) if c in df.columns and c != "datetime"]
    return df.select(name.alias("station"), ts.alias("ts"), *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in sensors])


def extracted_csv(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """station, ts, value of a wide file: datetime and a column per station."""
    df = spark.read.option("header", True).csv(path)
    names = [c for c in df.columns if c != "datetime"]
    rows = df.select(F.col("datetime").cast("timestamp_ntz").alias("ts"), *[F.col(c).cast("double") for c in names])
    return rows.unpivot("ts", names, "station", value)


def index_csv(spark: SparkSession, path: str, start: str = "1980-01-01", end: str = "2023-12-31") -> DataFrame:
    """time, value of a long index file whose first column is a date."""
    df = spark.read.option("header", True).csv(path)
    rows = df.select(F.to_date(F.col(df.columns[0])).alias("time"), F.col("value").cast("double").alias("value"))
    return rows.where(F.col("time").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def gauge_sums(df: DataFrame) -> DataFrame:
    """Sums of all columns but the last."""
    return df.agg(*[F.sum(c).alias(c) for c in df.columns[:-1]])


def long_to_wide(df: DataFrame, stations: Sequence[str], value: str = "value", time: str = "ts") -> DataFrame:
    """A column per station; of several values of a station at one time the largest."""
    return df.groupBy(time).pivot("station", list(stations)).agg(F.max(value))
