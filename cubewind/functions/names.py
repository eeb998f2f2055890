"""Names, labels and attributes as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
STATIC = ("hgt", "landmask", "lai", "lu_index")
AXIS_LABELS = {
    "t2": "air temperature in °C",
    "t2max": "max. air temperature in °C",
    "theta": "potential air temperature in °C",
    "geopotential": "geopotential height in m",
    "prcp": "precipitation in mm",
    "et": "actual evapotranspiration in mm",
    "wateravailability": "net precipitation in mm",
    "net precipitation": "net precipitation in mm",
    "q2": "mixing ratio in g kg⁻¹",
    "q": "mixing ratio in g kg⁻¹",
    "w": "vertical velocity in cm s⁻¹",
    "qvapor": "water vapour mixing ratio in g kg⁻¹",
    "qsolid": "solid water mixing ratio in g kg⁻¹",
    "qliquid": "liquid water mixing ratio in g kg⁻¹",
    "pblh": "planetary boundary layer height in m",
}
MERCATOR_RADIUS = 6378137.0


def normalize_whitespace(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^ | $", "")


def strip_non_alnum(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}\p{N}]", "")


def superscript(s: Column) -> Column:
    return F.translate(s.cast("string"), "-0123456789", "⁻⁰¹²³⁴⁵⁶⁷⁸⁹")


def unit_label(numerator: Column, denominator: Column, exponent: Column) -> Column:
    return F.trim(F.concat(numerator, F.lit(" "), denominator, superscript(exponent)))


def split_attribute(s: Column) -> Column:
    """By comma, else by blank."""
    return F.when(s.contains(","), F.split(s, ",")).otherwise(F.split(s, " "))


def proj_string(parameters: Column) -> Column:
    """+key=value of each entry of a map, in its order, and +no_defs."""
    parts = F.transform(F.map_entries(parameters), lambda x: F.concat(F.lit("+"), x["key"], F.lit("="), x["value"]))
    return F.concat_ws(" ", parts, F.lit("+no_defs"))


def envi_projection(attribute: Column) -> Column:
    """Projection string of an ENVI attribute; the usual one where it is null. An unknown projection is an error."""
    p = F.transform(split_attribute(attribute), lambda x: F.trim(x))
    name, datum = strip_non_alnum(F.element_at(p, -1)), strip_non_alnum(F.element_at(p, -2))
    kind = F.when(F.lower(name) == "wrfmercator", "merc").when(F.lower(name) == "wrflambertconformal", "lcc")
    kind = F.coalesce(kind, F.when(attribute.isNotNull(), F.raise_error(F.concat(F.lit("unknown projection "), name)).cast("string")))
    number = lambda k: p[k].cast("double").cast("string")
    parts = [("k_0", F.lit("1.0")), ("units", F.lit("m")), ("lat_0", number(3)), ("lon_0", number(4)), ("x_0", number(5)), ("y_0", number(6)), ("ellps", datum), ("datum", datum), ("name", name), ("proj", kind)]
    written = F.concat_ws(" ", *[F.concat(F.lit(f"+{k}="), v) for k, v in parts])
    parallels = F.when(kind == "lcc", F.concat(F.lit(" +sp1="), number(7), F.lit(" +sp2="), number(8))).otherwise("")
    usual = "+k_0=1.0 +units=m +lat_0=2.0 +lon_0=-90.31006622 +x_0=0.0 +y_0=0.0 +ellps=WGS84 +datum=WGS84 +name=WRFMercator +proj=merc +no_defs"
    return F.when(attribute.isNull(), F.lit(usual)).otherwise(F.concat(written, parallels, F.lit(" +no_defs")))


def grid_distance(first: Column, second: Column, axis: str) -> Column:
    """The first attribute that is there; an error if none is."""
    return F.coalesce(first, second, F.raise_error(F.lit(f"no grid distance for {axis}")).cast("double"))


def global_attributes(source: dict[str, str], grid: dict[str, float], domain: str, variable: str, created: str, more: dict[str, str] | None = None, notes: str | None = None) -> dict[str, str]:
    """Global attributes of a file of an experiment, from those of the model's output and the extent of its grid. `notes` say how
    its output was made; `more` (title, institution and the like) is taken over and wins."""
    words = source["TITLE"].split()
    # Fixed names and texts of the file format
    out = {
        **({"DATA_NOTES": notes} if notes else {}),
        "WRF_VERSION": " ".join(words[2:4]), "CREATION_DATE": created, "VARNAME": variable, "DOMAIN": domain.removeprefix("d").lstrip("0"), "NESTED": "NO" if domain == "d01" else "YES",
        "TIME_ZONE": "UTC", "PRODUCT_LEVEL": "H", "LEVEL_INFO": "H: original simulation output; D: daily; M: monthly; Y: yearly; S: static",
        "PROJ_NAME": source["MAP_PROJ_CHAR"], "PROJ_CENTRAL_LON": source["STAND_LON"], "PROJ_CENTRAL_LAT": source["MOAD_CEN_LAT"],
        "PROJ_STANDARD_PAR1": source["TRUELAT1"], "PROJ_STANDARD_PAR2": source["TRUELAT2"], "PROJ_SEMIMAJOR_AXIS": "6370000.0", "PROJ_SEMIMINOR_AXIS": "6370000.0",
        "PROJ_FALSE_EASTING": "0.0", "PROJ_FALSE_NORTHING": "0.0", "PROJ_DATUM": "WGS-84", "PYPROJ_SRS": source["pyproj_srs"],
        "GRID_INFO": "Grid spacing: GRID_DX and GRID_DY (unit: m), Down left corner: GRID_X00 and GRID_Y00 (unit: m), Upper Left Corner: GRID_X01 and GRID_Y01 (unit: m)",
        "GRID_DX": source["DX"], "GRID_DY": source["DY"],
    }
    return out | {k: str(v) for k, v in grid.items()} | (more or {})


def with_attributes(own: Column, more: Column) -> Column:
    """Two maps of attributes as one; the second wins."""
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(more, k)), more)


COORDINATES = "lon lat"  # what variables on the model grid name as their coordinates


def file_stem(kind: str, variables: list[str], start: str, end: str, levels: list[int] | None = None, low: float = 0.1, high: float = 2000, mask: bool = True, mask_sea: bool = False) -> str:
    where = f"p-{'-'.join(map(str, levels))}" if levels else f"hgt-{int(low)}-{int(high)}"
    return f"{kind}_{where}_v-{'-'.join(variables)}_y-{start[:4]}-{end[:4]}{'' if mask else '_nomask'}{'_masksea' if mask_sea else ''}"


def file_stem_column(kind: Column, variables: Column, start: Column, end: Column, levels: Column | None = None, low: float = 0.1, high: float = 2000, mask: bool = True, mask_sea: bool = False) -> Column:
    """file_stem() over columns: variables and levels are arrays, start and end dates; NULL or no levels give the height zone."""
    zone = F.lit(f"hgt-{int(low)}-{int(high)}")
    where = zone if levels is None else F.when(F.size(levels) > 0, F.concat(F.lit("p-"), F.array_join(levels.cast("array<string>"), "-"))).otherwise(zone)
    rest = ("" if mask else "_nomask") + ("_masksea" if mask_sea else "")
    return F.concat(kind, F.lit("_"), where, F.lit("_v-"), F.array_join(variables, "-"), F.lit("_y-"), F.year(start), F.lit("-"), F.year(end), F.lit(rest))


def lon_lat_label(metres: Column, axis: str) -> Column:
    """Degrees of a Web Mercator coordinate with the hemisphere."""
    if axis == "lon":
        degrees, plus, minus = F.degrees(metres / MERCATOR_RADIUS), "E", "W"
    else:
        degrees, plus, minus = F.degrees(2 * F.atan(F.exp(metres / MERCATOR_RADIUS)) - F.lit(3.141592653589793 / 2)), "N", "S"
    return F.concat(F.format_string("%.2f", F.abs(degrees)), F.lit("°"), F.when(F.round(degrees, 2) < 0, minus).when(F.round(degrees, 2) > 0, plus).otherwise(""))


def regression_label(mean: Column, slope: Column, r2: Column, significant: Column, unit: str, seasonal: bool = True) -> Column:
    """Mean, slope with its unit, R² and significance. A rate per year, hour or day loses its denominator in the slope."""
    top, _, bottom = unit.replace("degC", "°C").partition("/")
    slope_unit = top.replace("°C", "K")
    if bottom and bottom not in ("y", "a", "h", "d"):
        slope_unit += f" {bottom}⁻¹"
        slope_unit += " a⁻¹" if seasonal else ""
    else:
        slope_unit += " a⁻¹"
    p = F.when(significant, "p < 0.05").otherwise("p > 0.05")
    digits = "%.1f" if seasonal else "%.3f"
    return F.concat_ws(" | ", F.format_string(f"ȳ = {digits} {top}", mean), F.format_string(f"β = %.3f {slope_unit}", slope), F.format_string("R² = %.2f", r2), p)


def axis_label(variable: str, level: str | None = None) -> str:
    label = "layer thickness in m" if level and variable == "geopotential" else AXIS_LABELS.get(variable, variable)
    return f"{level} hPa {label}" if level else label
