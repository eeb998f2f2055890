"""Writing cubes, series and metadata."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cube(df: DataFrame, path: str, experiment: str, frequency: str, attributes: dict[str, str] | None = None, mode: str = "append") -> None:
    """Parquet by experiment, frequency and year, with a sidecar of attributes. Rows of a year go to as many files as AQE
    finds their size to need."""
    own = df.withColumns({"experiment": F.lit(experiment), "frequency": F.lit(frequency), "year": F.year("time")})
    own.hint("rebalance", "year").write.mode(mode).partitionBy("experiment", "frequency", "year").parquet(path)
    if attributes:
        rows = [(experiment, k, str(v)) for k, v in attributes.items()]
        df.sparkSession.createDataFrame(rows, "experiment string, key string, value string").write.mode("append").parquet(f"{path.rstrip('/')}_attributes")


def write_wide_csv(df: DataFrame, path: str, stations: Sequence[str]) -> None:
    """datetime and a column per station."""
    from cubewind.sources.files import long_to_wide

    long_to_wide(df, stations).withColumnRenamed("ts", "datetime").orderBy("datetime").write.mode("overwrite").option("header", True).csv(path)


def upsert_attributes(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """experiment, key, value; what is there stays unless it may be overwritten."""
    key = ["experiment", "key"]
    kept, added = (old.join(new, key, "left_anti"), new) if overwrite else (old, new.join(old, key, "left_anti"))
    return kept.unionByName(added)


def write_netcdf(df: DataFrame, path: str, variable: str, units: str = "", attributes: dict[str, str] | None = None, coordinates: dict[str, np.ndarray] | None = None, kind: str = "f4", mode: str = "overwrite") -> None:
    """A cube (time, level if any, j, i, variable) as one classic file on a mounted folder. attributes: of the file;
    coordinates: fixed fields such as lat and lon (j x i). Cells that no row has, and NULLs, are NaN; of repeated cells one stays.

    The driver knows the axes (a value per time and level); rows are dealt by their record, so a record is put together by one
    task from its own cells, and files grow with the number of records, not with what a task or the driver holds."""
    from cubewind.sources import netcdf

    netcdf.register(df.sparkSession)
    levelled = "level" in df.columns
    at = [r["time"] for r in df.select("time").where("time IS NOT NULL").distinct().orderBy("time").collect()]
    levels = [r["level"] for r in df.select("level").where("level IS NOT NULL").distinct().orderBy("level").collect()] if levelled else []
    size = df.agg(F.max("j").alias("j"), F.max("i").alias("i")).first()
    nj, ni = (size["j"] or 0) + 1, (size["i"] or 0) + 1
    since = str(at[0].replace(tzinfo=None) if hasattr(at[0], "hour") else at[0])[:19] if at else "1970-01-01"
    axis = [(np.datetime64(t, "us") - np.datetime64(since.replace(" ", "T"), "us")) / np.timedelta64(3600, "s") for t in at]
    own = {"units": units} | ({"coordinates": "lon lat"} if {"lon", "lat"} <= (coordinates or {}).keys() else {})
    head, step = netcdf.layout(variable, f">{kind}", len(at), nj, ni, levels, attributes or {}, own, coordinates or {}, since)
    place = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(at)], f"time {dict(df.dtypes)['time']}, record int")
    layer = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level")).cast("int") - 1, F.lit(-1)) if levels else F.lit(0)
    cells = df.join(F.broadcast(place), "time").select("record", ((layer * nj + F.col("j")) * ni + F.col("i")).alias("cell"), F.col(variable).cast("double").alias("value"), layer.alias("layer"))  # a row per time
    cells = cells.where("layer >= 0 AND cell IS NOT NULL").drop("layer").repartition("record").sortWithinPartitions("record")
    count = max(len(levels), 1) * nj * ni

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, values = None, np.full(count, np.nan, f">{kind}")
        full = lambda: pa.record_batch([pa.array([record], pa.int32()), pa.array([values.tobytes() + b"\0" * (-values.nbytes % 4)], pa.binary())], names=["record", "values"])
        for b in batches:
            own, cell = b.column("record").to_numpy(), b.column("cell").to_numpy()
            value = b.column("value").to_numpy(zero_copy_only=False)
            for k in np.unique(own):
                if k != record:
                    if record is not None:
                        yield full()
                    record, values = int(k), np.full(count, np.nan, f">{kind}")
                values[cell[own == k]] = value[own == k]
        if record is not None:
            yield full()

    rows = cells.mapInArrow(put_together, "record int, values binary")
    options = {"path": path, "head": head.hex(), "step": str(step), "records": str(len(at)), "axis": json.dumps(axis), "missing": f">{kind}"}
    rows.write.format("netcdf").options(**options).mode(mode).save()
