"""Series: bins with a calendar, running sums and means. Windows without a partition are for series that are reduced already."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def daily(df: DataFrame, value: str, by: Sequence[str], how: str = "sum", time: str = "ts") -> DataFrame:
    """A row per key and day from its first to its last: sums of days without rows are 0, means NULL. Each day with rows brings
    the days up to the next one along, so there is no calendar to join, and windows by key that follow don't shuffle again."""
    fn = {"sum": F.sum, "mean": F.avg}[how]
    bins = df.where(F.col(time).isNotNull()).groupBy(*by, F.to_date(time).alias("_day")).agg(fn(value).alias(value))
    following = F.coalesce(F.date_sub(F.lead("_day").over(Window.partitionBy(*by).orderBy("_day")), 1), F.col("_day"))
    out = bins.withColumn("_last", following).select(*by, value, "_day", F.explode(F.sequence("_day", "_last", F.expr("INTERVAL 1 DAY"))).alias("day"))
    own = F.when(F.col("day") == F.col("_day"), F.col(value))
    return out.select(*by, "day", (F.coalesce(own, F.lit(0.0)) if how == "sum" else own).alias(value))


def calendar_spine(spark, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)")).alias("day"))


def cumulative(df: DataFrame, value: str, by: Sequence[str], order: str = "day", name: str = "cumulative") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def rolling_mean(df: DataFrame, value: str, size: int = 5, by: Sequence[str] = (), order: str = "time", name: str = "rolling") -> DataFrame:
    """Trailing; NULL unless all `size` values are there."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == size, F.avg(value).over(w)))


def lag1_autocorrelation(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    mean = df.withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    both = mean.withColumn("_b", F.lag("_e").over(Window.partitionBy(*by).orderBy(order)))
    return both.groupBy(*by).agg((F.sum(F.col("_e") * F.col("_b")) / F.sum(F.col("_e") * F.col("_e"))).alias("acf1"))


def calendar_of(df: DataFrame, time: str) -> DataFrame:
    """All days from the first to the last time of a frame."""
    ends = df.agg(F.to_date(F.min(time)).alias("_a"), F.to_date(F.max(time)).alias("_z")).where("_a IS NOT NULL")  # one row
    return ends.select(F.explode(F.sequence("_a", "_z")).alias("day"))
