"""Seasons, their lengths, and time axes of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("JFM", "AMJ", "JAS", "OND")
WET_MONTHS = (12, 1, 2, 3, 4, 5)


def season(time: Column) -> Column:
    """1 to 4: JFM, AMJ, JAS, OND."""
    return F.quarter(time)


def season_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), code)


def season_label(time: Column) -> Column:
    """Meteorological seasons: DJF, MAM, JJA, SON."""
    return F.element_at(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), (F.floor(F.pmod(F.month(time), F.lit(12)) / 3) + 1).cast("int"))


def month_length(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def hours_of_month(year: Column, month: Column) -> Column:
    """All hours of a month, as an array."""
    first = F.make_date(year, month, F.lit(1)).cast("timestamp_ntz")
    return F.sequence(first, F.add_months(first, 1).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))


def dry_wet(time: Column) -> Column:
    """1 from December to May, else 2."""
    return F.when(F.month(time).isin(*WET_MONTHS), 1).otherwise(2)


def days_in_season(year: Column, code: Column) -> Column:
    """Both ends count."""
    first = F.make_date(year, code * 3 - 2, F.lit(1))
    return F.datediff(F.add_months(first, 3), first)


def days_in_year(year: Column) -> Column:
    return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))


def first_day_of_month(year: Column, month: Column) -> Column:
    """Day of the year, from 0."""
    return F.dayofyear(F.make_date(year, month, F.lit(1))) - 1


def corrected_time(value: Column, unit: Column) -> tuple[Column, Column]:
    """Time values and unit of a file: months since a year become days of that year; of years only the unit is renamed."""
    year = F.regexp_extract(unit, r"since (\d{4})", 1).cast("int")
    months = F.lower(unit).startswith("months since")
    years = F.lower(unit).startswith("years since")
    day = F.datediff(F.make_date(year + F.floor(value / 12).cast("int"), (F.pmod(value.cast("int"), F.lit(12)) + 1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))
    return F.when(months, day.cast("double")).otherwise(value.cast("double")), F.when(months | years, F.regexp_replace(unit, "^(?i)(months|years)", "days")).otherwise(unit)


def cf_time(value: Column, unit: str) -> Column:
    """Numbers of a CF time axis ('hours since 1980-01-01') as timestamps without zone."""
    kind, _, start = unit.partition(" since ")
    seconds = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}[kind.strip().lower()]
    return F.to_timestamp_ntz(F.lit(start.strip()[:19])) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (value * seconds).cast("decimal(18,6)"))


def local_to_utc(time: Column, zone: str = "Pacific/Galapagos") -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), time)
