"""Warm, cold and neutral years of a monthly index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubewind.operators import series

THRESHOLD = 1.13


def long_index(wide: DataFrame) -> DataFrame:
    """time, value from a column per month; NaN is NULL."""
    months = [c for c in wide.columns if c.isdigit()]
    rows = wide.unpivot("year", months, "month", "value")
    return rows.select(F.make_date("year", F.col("month").cast("int"), F.lit(1)).alias("time"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def _class(threshold: float) -> Column:
    return F.when(F.max("value") >= threshold, 1).when(F.min("value") <= -threshold, -1).otherwise(0)


def classify_years(index: DataFrame, threshold: float = THRESHOLD, smooth: int = 5) -> DataFrame:
    """year, class (1, -1, 0; 1 where both hold), by the extremes of the rolling mean."""
    rolled = series.rolling_mean(index, "value", smooth).drop("value").withColumnRenamed("rolling", "value")
    return rolled.groupBy(F.year("time").alias("year")).agg(_class(threshold).alias("class"), F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.avg("value").alias("mean_value"))


def classify_seasons(index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """season, year, class, by the months of the season themselves."""
    return index.groupBy(F.quarter("time").alias("season"), F.year("time").alias("year")).agg(_class(threshold).alias("class"))


def composite_difference(warm: DataFrame, cold: DataFrame, column: str) -> DataFrame:
    """warm - cold by cell and position of the day in each composite: the first day of one meets the first of the other.
    Only the distinct days are numbered."""

    def numbered(df: DataFrame, name: str) -> DataFrame:
        days = df.select("time").distinct().withColumn("day", F.row_number().over(Window.orderBy("time")))
        return df.join(days, "time").select("day", "j", "i", F.col(column).alias(name))

    both = numbered(warm, "_warm").join(numbered(cold, "_cold"), ["day", "j", "i"])
    return both.select("day", "j", "i", (F.col("_warm") - F.col("_cold")).alias(column))


def masks(column: Column) -> dict[str, Column]:
    return {"nino": column == 1, "nina": column == -1, "no_nino": column != 1, "no_nina": column != -1}
