"""Units of cube variables. A conversion is value * scale + offset, so it stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of units in files
UNIT_ALIASES = {"k": "K", "w m-2": "W/m**2", "pa": "Pa"}

# Fixed values: (scale, offset, new unit) by unit
CONVERSIONS = {
    "K": (1.0, -273.15, "degC"),
    "mm/h": (24.0, 0.0, "mm/d"),
    "kg/kg": (1000.0, 0.0, "g/kg"),
    "Pa": (0.01, 0.0, "hPa"),
    "m**2/s**2": (1 / 9.80665, 0.0, "m"),
}

# What maps show, by variable
MAP_UNITS = {"prcp": "mm/d", "et": "mm/d", "potevap": "mm/d", "t2": "degC", "psfc": "hPa"}

#: Means of these are turned into totals; they are rates per day.
BAR_VARS = ("prcp", "et", "wateravailability", "netprcp")

# Sensor columns of model variables, and their units
SENSORS = {
    "prcp": ["PCP_tot_bucket", "PCP_diff_radar", "PCP_diffmin_radar", "PCP_acoustic"],
    "t2": ["T"],
    "ws10": ["WS", "WSmax"],
    "wd10": ["WD"],
    "v10": ["WD"],
    "u10": ["WD"],
    "rh2": ["RH"],
    "swdown": ["SLR"],
    "psfc": ["Pabs"],
    "sh2": ["SH"],
    "q2": ["Q"],
}
SENSOR_UNITS = {
    "PCP_tot_bucket": "mm",
    "PCP_diff_radar": "mm",
    "PCP_diffmin_radar": "mm/min",
    "PCP_acoustic": "mm",
    "T": "K",
    "RH": "%",
    "Pabs": "hPa",
    "WS": "m/s",
    "WSmax": "m/s",
    "WD": "degree",
    "FOG": "g",
    "SLR": "W/m**2",
    "ST": "K",
    "Vwc": "count",
    "SH": "g/kg",
    "Q": "kg/kg",
}

# Names that mean the same variable
VARIABLE_NAMES = [
    ["prcp", "PCP"],
    ["hgt"],
    ["et"],
    ["cape"],
    ["cin"],
    ["potevap"],
    ["t2", "T"],
    ["t2c", "T"],
    ["q2", "q"],
    ["rh", "RH"],
    ["rh2", "RH"],
    ["sh2", "SH"],
    ["ws10", "ws"],
    ["wd10", "WDIR"],
    ["swdown", "SLR"],
    ["psfc", "Pabs"],
]


def canonical_unit(unit: str) -> str:
    return UNIT_ALIASES.get(unit.lower(), unit)


def conversion(unit: str, variable: str | None = None) -> tuple[float, float, str]:
    """Scale, offset and unit in which a variable is shown; the vertical wind w also goes to cm/s."""
    scale, offset, new = CONVERSIONS.get(canonical_unit(unit), (1.0, 0.0, canonical_unit(unit)))
    return (scale * 100, offset * 100, "cm/s") if variable == "w" else (scale, offset, new)


def convert(value: Column, unit: str, variable: str | None = None) -> Column:
    scale, offset, _ = conversion(unit, variable)
    out = value * F.lit(scale) if scale != 1.0 else value
    return out + F.lit(offset) if offset else out


def convert_column(df: DataFrame, column: str, unit: str, variable: str | None = None) -> DataFrame:
    """The column in its new unit, which its metadata names."""
    return df.withColumn(column, convert(F.col(column), unit, variable)).withMetadata(column, {"units": conversion(unit, variable)[2]})


def names_of(variable: str) -> list[str]:
    """All names of a variable; the first group that has it in lower case."""
    for group in VARIABLE_NAMES:
        if variable.lower() in group:
            return group
    raise NameError(f"no names are known for {variable}")


def names_column(variable: Column) -> Column:
    """names_of() over a column; null where no group has it."""
    out = F.lit(None).cast("array<string>")
    for group in reversed(VARIABLE_NAMES):
        out = F.when(F.lower(variable).isin(group), F.array(*map(F.lit, group))).otherwise(out)
    return out


def sensors_column(variable: Column) -> Column:
    pairs = [x for k, v in SENSORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.create_map(*pairs)[variable]
