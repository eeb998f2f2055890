"""Cubes, grids and experiments.

A cube is a tidy frame: `time`, optionally `level`, grid indices `j` (south_north) and `i` (west_east), and a column per
variable; a missing value is NULL. A grid is a frame of `j`, `i` and static columns (`lat`, `lon`, `hgt`, `landmask`, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubewind.functions import units
from cubewind.operators import masks, reduce, select

KEYS = ("time", "level", "j", "i")


def without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN as NULL, so that aggregates skip it; all floating columns by default."""
    columns = columns or tuple(c for c, kind in df.dtypes if kind in ("double", "float"))
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def primary_variable(df: DataFrame, attributes: dict[str, str] | None = None) -> str:
    """The attribute VARNAME, else the last column that isn't a key."""
    return (attributes or {}).get("VARNAME") or [c for c in df.columns if c not in KEYS and c != "bnds"][-1]


@dataclass(frozen=True)
class Cube:
    """A fluent wrapper: each method returns a new cube with a lazy frame."""

    df: DataFrame
    grid: DataFrame | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    @property
    def variable(self) -> str:
        return primary_variable(self.df, self.attributes)

    def transform(self, fn: Callable[..., DataFrame], *args, **kw) -> Cube:
        return replace(self, df=fn(self.df, *args, **kw))

    def between(self, start: str, end: str) -> Cube:
        return self.transform(select.time_slice, start, end)

    def level(self, *levels: int) -> Cube:
        return self.transform(select.level_difference, self.variable, *levels) if len(levels) == 2 else self.transform(select.level, levels[0])

    def crop_margins(self, size: tuple[int, int], mask: bool = True) -> Cube:
        return self.transform(select.crop, size, 40 if mask else 5)

    def mask_height_zone(self, low: float, high: float) -> Cube:
        return self.transform(masks.height_zone, self.grid, low, high)

    def mask_sea(self) -> Cube:
        return self.transform(masks.mask_sea, self.grid)

    def mask_ocean(self) -> Cube:
        return self.transform(masks.mask_ocean, self.grid)

    def convert_units(self) -> Cube:
        unit = self.attributes.get("units", "")
        new = units.conversion(unit, self.variable)[2]
        return replace(self, df=units.convert_column(self.df, self.variable, unit, self.variable), attributes=self.attributes | {"units": new})

    def spatial_mean(self) -> Cube:
        return self.transform(reduce.spatial_mean, [self.variable])

    def rename(self, new: str, unit: str | None = None) -> Cube:
        return replace(self, df=self.df.withColumnRenamed(self.variable, new), attributes=self.attributes | {"VARNAME": new} | ({"units": unit} if unit else {}))


@dataclass(frozen=True)
class Experiment:
    """A cube with names, static fields, station series and extracted points."""

    name: str
    cube: Cube
    measurements: dict[str, DataFrame] = field(default_factory=dict)
    extracted: DataFrame | None = None

    def __post_init__(self):
        missing = {"VARNAME", "units"} - set(self.cube.attributes)
        if missing:
            raise ValueError(f"attributes are missing: {sorted(missing)}")

    @property
    def names(self) -> list[str]:
        return units.names_of(self.cube.variable)

    def add_measurements(self, frames: dict[str, DataFrame]) -> Experiment:
        return replace(self, measurements=self.measurements | frames)

    def add_extracted(self, df: DataFrame, source: str) -> Experiment:
        """Series of simulated points; the source must name the variable."""
        if not any(n.lower() in source.lower().rsplit("/", 1)[-1].split("_") for n in self.names):
            raise ValueError(f"{source} is none of {self.names}")
        return replace(self, extracted=df)

    def add_product(self, other: DataFrame, how: str = "inner") -> Experiment:
        from cubewind.operators.joins import merge_variables

        return replace(self, cube=replace(self.cube, df=merge_variables(self.cube.df, other, how=how)))

    def concat(self, others: Sequence[Experiment]) -> Experiment:
        df = self.cube.df
        for o in others:
            df = df.unionByName(o.cube.df)
        return replace(self, cube=replace(self.cube, df=df))
