"""Means, totals and summaries. Spatial means come before means over time, in two steps: masks can differ from time to time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewind.functions import calendar


def _means(columns: Sequence[str]) -> list[Column]:
    return [F.avg(c).alias(c) for c in columns]


def spatial_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unweighted mean over cells, by time and level."""
    return df.groupBy(*[c for c in ("time", "level") if c in df.columns]).agg(*_means(columns))


def temporal_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy("j", "i").agg(*_means(columns))


def yearly_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.year("time").alias("year")).agg(*_means(columns))


def season_year_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, calendar.season(F.col("time")).alias("season"), F.year("time").alias("year")).agg(*_means(columns))


def dry_wet_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(calendar.dry_wet(F.col("time")).alias("dry_wet")).agg(*_means(columns))


def yearly_total(means: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Yearly means of daily rates as totals of the whole calendar year."""
    return means.withColumns({c: F.col(c) * calendar.days_in_year(F.col("year")) for c in columns})


def season_total(means: DataFrame, columns: Sequence[str]) -> DataFrame:
    return means.withColumns({c: F.col(c) * calendar.days_in_season(F.col("year"), F.col("season")) for c in columns})


def subset_anomalies(df: DataFrame, column: str, masks: dict[str, Column]) -> DataFrame:
    """Mean, and for each mask the mean of what it holds and its difference from the mean; one pass."""
    mean = df.agg(F.avg(column).alias("mean"), *[F.avg(F.when(m, F.col(column))).alias(f"mean_{k}") for k, m in masks.items()])
    return mean.select("*", *[(F.col(f"mean_{k}") - F.col("mean")).alias(f"anomaly_{k}") for k in masks])


def symmetric_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.greatest(F.abs(F.min(column)), F.max(column)).alias("limit"))


def column_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sum of each gauge column."""
    return df.agg(*[F.sum(c).alias(c) for c in columns])


def annual_rate(value: Column) -> Column:
    """Per hour to per year."""
    return value * 24 * 365


def total_precipitation(df: DataFrame, column: str) -> DataFrame:
    """Sum over time of metres of water, in millimetres, per cell."""
    return df.groupBy("j", "i").agg((F.sum(column) * 1000).alias(column))


def level_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over levels, by time and cell."""
    return df.groupBy("time", "j", "i").agg(*_means(columns))


def grid_metadata(grid: DataFrame) -> DataFrame:
    """Extent and size of a grid in metres."""
    return grid.agg(
        F.min("x_m").alias("GRID_X00"), F.min("y_m").alias("GRID_Y00"), F.min("x_m").alias("GRID_X01"), F.max("y_m").alias("GRID_Y01"),
        F.countDistinct("x_m").cast("long").alias("GRID_NX"), F.countDistinct("y_m").cast("long").alias("GRID_NY"),
    )


def years(df: DataFrame) -> DataFrame:
    return df.select(F.year("time").alias("year")).distinct()
