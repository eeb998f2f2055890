"""Selections. Time is always given as bounds, so that they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def time_slice(df: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends count; an end without a time of day is its midnight."""
    return df.where(F.col("time").between(_ts(start), _ts(end)))


def date_slice(df: DataFrame, start: str, end: str) -> DataFrame:
    """Whole days, the last included."""
    return df.where((F.col("time") >= _ts(start)) & (F.col("time") < (_ts(end) + F.expr("INTERVAL 1 DAY"))))


def level(df: DataFrame, value: int) -> DataFrame:
    return df.where(F.col("level") == value)


def level_difference(df: DataFrame, variable: str, first: int, second: int) -> DataFrame:
    """second - first where both are there, in one pass."""
    at = lambda k: F.max(F.when(F.col("level") == k, F.col(variable)))
    there = lambda k: F.max(F.when(F.col("level") == k, True))
    both = df.where(F.col("level").isin(first, second)).groupBy("time", "j", "i").agg(at(first).alias("_a"), at(second).alias("_b"), there(first).alias("_x"), there(second).alias("_y"))
    return both.where("_x AND _y").select("time", "j", "i", (F.col("_b") - F.col("_a")).alias(variable))


def crop(df: DataFrame, size: tuple[int, int], cells: int) -> DataFrame:
    """Without `cells` rows and columns on each side of a grid of size (n_j, n_i)."""
    nj, ni = size
    return df.where(F.col("j").between(cells, nj - cells - 1) & F.col("i").between(cells, ni - cells - 1))


def first_time(df: DataFrame) -> DataFrame:
    """The rows of the first time step."""
    first = df.agg(F.min("time").alias("_first"))
    return df.join(F.broadcast(first), df["time"] == first["_first"], "left_semi")  # one row


def first_steps(df: DataFrame, steps: int = 24, by: Sequence[str] = ()) -> DataFrame:
    """The rows of the first time steps, of each group of files or runs if there are any. Only distinct times are ranked."""
    times = df.select(*by, "time").distinct()
    early = times.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("time"))).where(F.col("_k") <= steps)
    return df.join(early.drop("_k"), [*by, "time"], "left_semi")


def stride(df: DataFrame, offset: int = 4, step: int = 7) -> DataFrame:
    """Every step-th cell of the first time step."""
    on = lambda c: (F.col(c) >= offset) & (F.pmod(F.col(c) - offset, F.lit(step)) == 0)
    return first_time(df).where(on("j") & on("i"))


def season(df: DataFrame, code: int) -> DataFrame:
    return df.where(F.quarter("time") == code)


def months(df: DataFrame, *values: int) -> DataFrame:
    return df.where(F.month("time").isin(*values))


def same_times(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose time the other frame has."""
    return df.join(other.select("time").distinct(), "time", "left_semi")


def exact_times(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows at the times of another frame; an error if df lacks one of them."""
    there = df.select("time").distinct().withColumn("_there", F.lit(True))
    wanted = other.select("time").where("time IS NOT NULL").distinct().join(there, "time", "left")
    missing = F.raise_error(F.concat(F.lit("no such time: "), F.col("time").cast("string"))).cast("boolean")
    return df.join(wanted.where(F.coalesce("_there", missing)).select("time"), "time", "left_semi")


def marked(df: DataFrame, variable: str) -> DataFrame:
    return df.where(F.col(variable).isNotNull() & (F.col(variable) != 0))


def box(df: DataFrame, lon: tuple[float, float], lat: tuple[float, float], buffer: float = 1.0) -> DataFrame:
    return df.where(F.col("lon").between(lon[0] - buffer, lon[1] + buffer) & F.col("lat").between(lat[0] - buffer, lat[1] + buffer))


def download_allowed(area: float, product: str) -> bool:
    """Square degrees that may be asked of an elevation service at once."""
    return area <= {"SRTM1": 2.0, "SRTM3": 50.0}[product]
