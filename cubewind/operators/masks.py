"""Masks keep rows and make values NULL. The grid is a dimension table; the optimizer broadcasts it where it is small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = ("time", "level", "j", "i")


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in _KEYS]


def where_grid(df: DataFrame, grid: DataFrame, keep: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Values of the cells for which `keep`, an expression over grid columns, holds. Cells that the grid lacks have none."""
    own = grid.select("j", "i", keep.alias("_keep"))
    out = df.join(own, ["j", "i"], "left")
    return out.select(*[F.when(F.col("_keep"), F.col(c)).alias(c) if c in (columns or variables(df)) else F.col(c) for c in df.columns])


def height_zone(df: DataFrame, grid: DataFrame, low: float, high: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Land cells with low <= hgt <= high."""
    return where_grid(df, grid, F.col("hgt").between(low, high) & (F.col("landmask") > 0), columns)


def half_open_zone(df: DataFrame, grid: DataFrame, low: float, high: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells with low <= hgt < high."""
    return where_grid(df, grid, (F.col("hgt") >= low) & (F.col("hgt") < high), columns)


def mask_sea(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Sea cells only."""
    return where_grid(df, grid, F.col("landmask") == 0)


def mask_ocean(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Land cells only."""
    return where_grid(df, grid, F.col("landmask") == 1)


def altitude_class(hgt: Column, landmask: Column) -> Column:
    """1 below 100 m, 2 below 900 m, 3 above; no class at sea."""
    return F.when(landmask > 0, F.when(hgt < 100, 1).when(hgt < 900, 2).when(hgt >= 900, 3))


def positive(elevation: Column) -> Column:
    return F.when(elevation > 0, elevation)


def zone_means(df: DataFrame, grid: DataFrame, edges: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """Mean of each variable in each half-open height zone; one pass for all zones."""
    zone = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        zone = F.when((F.col("hgt") >= edges[k]) & (F.col("hgt") < edges[k + 1]), k + 1).otherwise(zone)
    zoned = df.join(grid.select("j", "i", zone.alias("zone")), ["j", "i"]).where("zone IS NOT NULL")
    return zoned.groupBy("zone").agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
