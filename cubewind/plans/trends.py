"""The analysis from cube to fits as one lazy frame, described by a specification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubewind.functions import units
from cubewind.functions.names import file_stem
from cubewind.operators import enso, masks, reduce, regression, select

KINDS = ("full_year", "timeseries", "regression", "mean", "trend", "map")


@dataclass(frozen=True)
class Spec:
    """What to analyse. mask_sea has no effect where a height zone is masked. scale 'own' multiplies each variable by days
    if it is a rate itself; 'primary' does so for both axes if the first variable is one."""

    kind: str
    variables: Sequence[str]
    size: tuple[int, int]
    start: str = "1980-01-01"
    end: str = "2023-12-31"
    frequency: str = "m"
    units: Sequence[str] = ()
    levels: Sequence[int] = ()
    margin: int = 40
    mask: bool = True
    mask_sea: bool = False
    low: float = 0.1
    high: float = 2000.0
    scale: str = "own"
    threshold: float = enso.THRESHOLD

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if self.frequency == "y" and self.kind in ("timeseries", "regression", "mean"):
            raise ValueError("seasons need monthly or finer data")
        if len(self.levels) > 2:
            raise ValueError("one level, or two for a difference")

    @property
    def stem(self) -> str:
        return file_stem(self.kind, list(self.variables), self.start, self.end, list(self.levels) or None, self.low, self.high, self.mask, self.mask_sea)


def prepared(cube: DataFrame, grid: DataFrame, spec: Spec) -> DataFrame:
    """Level, period, margins, mask and units, in this order."""
    df = cube
    if len(spec.levels) == 2:
        df = select.level_difference(select.time_slice(df, spec.start, spec.end), spec.variables[0], *spec.levels)
    else:
        df = select.time_slice(select.level(df, spec.levels[0]) if spec.levels else df, spec.start, spec.end)
    df = select.crop(df, spec.size, spec.margin).select("time", "j", "i", *spec.variables)
    if spec.mask:
        df = masks.height_zone(df, grid, spec.low, spec.high)
    elif spec.mask_sea:
        df = masks.mask_sea(df, grid)
    for v, unit in zip(spec.variables, spec.units, strict=False):
        df = units.convert_column(df, v, unit, v)
    return df


def _scaled(spec: Spec) -> list[str]:
    own = [v for v in spec.variables if v in units.BAR_VARS]
    return own if spec.scale == "own" else list(spec.variables) if spec.variables[0] in units.BAR_VARS else []


def seasonal(cube: DataFrame, grid: DataFrame, spec: Spec) -> DataFrame:
    """season, year and the variables: means over cells, then over the months of the season, rates as totals."""
    series = reduce.spatial_mean(prepared(cube, grid, spec), spec.variables)
    return reduce.season_total(reduce.season_year_mean(series, spec.variables), _scaled(spec))


def run(cube: DataFrame, grid: DataFrame, spec: Spec, index: DataFrame | None = None) -> DataFrame:
    """A row per fit (timeseries, regression and mean by season; full_year; trend by cell), or the map of means."""
    y = spec.variables[-1]
    if spec.kind in ("timeseries", "regression", "mean"):
        x = "year" if len(spec.variables) == 1 else spec.variables[0]
        return regression.ols(seasonal(cube, grid, spec), y, x, ["season"])
    df = prepared(cube, grid, spec)
    if spec.kind == "map":
        return reduce.temporal_mean(df, spec.variables)
    if spec.kind == "trend":
        return regression.trend_map(reduce.yearly_mean(df, [y], ["j", "i"]), y)
    yearly = reduce.yearly_total(reduce.yearly_mean(reduce.spatial_mean(df, spec.variables), spec.variables), _scaled(spec))
    if index is not None:
        yearly = yearly.join(enso.classify_years(index, spec.threshold).select("year", "class"), "year", "left")
        fit = regression.ols(yearly, y, "year")
        return fit.join(F.broadcast(reduce.subset_anomalies(yearly, y, enso.masks(F.col("class")))))  # one row each
    return regression.ols(yearly, y, "year")


def yearly_and_fit(cube: DataFrame, grid: DataFrame, spec: Spec, bar: str, line: str) -> tuple[DataFrame, DataFrame]:
    """Totals of one variable per season and year, and the seasonal fits of another."""
    means = seasonal(cube, grid, spec)
    return means.select("season", "year", bar), regression.ols(means, line, "year", ["season"])
