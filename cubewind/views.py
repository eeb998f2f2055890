"""The driver's tables as cube, grid, index and observations, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NJ, NI = 10, 20

CTE = """
WITH cube AS (
  SELECT CAST(l_suppkey % 10 AS INT) AS j, CAST(l_partkey % 20 AS INT) AS i, l_linenumber AS level, l_shipdate AS "time", l_extendedprice AS v, l_quantity AS w FROM lineitem),
grid AS (
  SELECT j, i, (i * 137 + j * 61) % 2500 AS hgt, CASE WHEN (i + j) % 3 = 0 THEN 0 ELSE 1 END AS landmask,
         CAST(-1.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * j AS lat, CAST(-91.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * i AS lon, CAST(2000 AS DOUBLE) * i AS x_m, CAST(2000 AS DOUBLE) * j AS y_m
  FROM (SELECT CAST(range AS INT) AS j FROM range(10)), (SELECT CAST(range AS INT) AS i FROM range(20))),
monthly AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS "time", avg(o_totalprice) AS m FROM orders GROUP BY 1),
idx AS (
  SELECT "time", (m - (SELECT avg(m) FROM monthly)) / (SELECT stddev_samp(m) FROM monthly) AS value FROM monthly),
obs AS (
  SELECT CAST(user_id % 12 AS INT) AS station, ts, event_type AS sensor, value FROM events),
field AS (
  SELECT j, i, CAST(sum(w) AS BIGINT) % 2500 AS hgt, CAST(CASE WHEN count(*) % 3 = 0 THEN 0 ELSE 1 END AS INT) AS landmask,
         CAST(-1.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * j AS lat, CAST(-91.5 AS DOUBLE) + CAST(0.05 AS DOUBLE) * i AS lon, CAST(2000 AS DOUBLE) * i AS x_m, CAST(2000 AS DOUBLE) * j AS y_m
  FROM cube GROUP BY j, i),
sites AS (
  SELECT s_suppkey AS k, s_name AS station, CAST(-1.50003 AS DOUBLE) + CAST(0.00088 AS DOUBLE) * (s_suppkey * 37 % 499) AS slat, CAST(-91.50003 AS DOUBLE) + CAST(0.00096 AS DOUBLE) * (s_suppkey * 61 % 997) AS slon FROM supplier),
places AS (
  SELECT c_custkey AS k, CAST(-10 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (c_custkey * 37 % 2003) AS lat, CAST(-99 AS DOUBLE) + CAST(0.01 AS DOUBLE) * (c_custkey * 61 % 2801) AS lon FROM customer)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_suppkey") % NJ).cast("int").alias("j"), (F.col("l_partkey") % NI).cast("int").alias("i"), F.col("l_linenumber").alias("level"), F.col("l_shipdate").alias("time"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))


def grid(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    cells = spark.range(NJ * NI).select(F.floor(F.col("id") / NI).cast("int").alias("j"), (F.col("id") % NI).cast("int").alias("i"))
    return cells.select(
        "j", "i", ((F.col("i") * 137 + F.col("j") * 61) % 2500).alias("hgt"), F.when((F.col("i") + F.col("j")) % 3 == 0, 0).otherwise(1).alias("landmask"),
        (-1.5 + 0.05 * F.col("j")).alias("lat"), (-91.5 + 0.05 * F.col("i")).alias("lon"), (2000.0 * F.col("i")).alias("x_m"), (2000.0 * F.col("j")).alias("y_m"),
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "month").alias("time")).agg(F.avg("o_totalprice").alias("m"))
    every = Window.partitionBy()  # a row per month
    return monthly.select("time", ((F.col("m") - F.avg("m").over(every)) / F.stddev_samp("m").over(every)).alias("value"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 12).cast("int").alias("station"), "ts", F.col("event_type").alias("sensor"), "value")


def _at(df: DataFrame) -> DataFrame:
    """df by (j, i) with the places of a regular grid."""
    places = {"lat": -1.5 + 0.05 * F.col("j"), "lon": -91.5 + 0.05 * F.col("i"), "x_m": 2000.0 * F.col("i"), "y_m": 2000.0 * F.col("j")}
    return df.withColumns(places)


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static field over the cells that the cube has: from its quantities, so that it grows with the table."""
    land = F.when(F.count(F.lit(1)) % 3 == 0, 0).otherwise(1)
    return _at(cube(spark, sf_dir).groupBy("j", "i").agg((F.sum("w").cast("long") % 2500).alias("hgt"), land.alias("landmask")))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations on and between the cells, one per supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("k"), F.col("s_name").alias("station"), (-1.50003 + 0.00088 * (k * 37 % 499)).alias("lat"), (-91.50003 + 0.00096 * (k * 61 % 997)).alias("lon"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places over all domains, one per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (-10 + 0.01 * (k * 37 % 2003)).alias("lat"), (-99 + 0.01 * (k * 61 % 2801)).alias("lon"))
