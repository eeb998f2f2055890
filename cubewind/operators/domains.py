"""Nested model domains of a namelist, and map projections on a sphere."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPHERE = 6_370_000.0
WEB_SPHERE = 6_378_137.0
_LISTS = ("parent_id", "parent_grid_ratio", "i_parent_start", "j_parent_start", "e_we", "e_sn")
_NUMBERS = ("dx", "dy", "ref_lat", "ref_lon", "truelat1", "truelat2", "stand_lon")
Plane = tuple[Callable[[float, float], tuple[float, float]], Callable[[float, float], tuple[float, float]]]


def parse_namelist(text: str) -> dict[str, list[int] | float | str]:
    """Keys of a namelist that describe domains; others are ignored."""
    out: dict[str, list[int] | float | str] = {}
    for m in re.finditer(r"^[ \t]*(\w+)[ \t]*=[ \t]*(.*)$", text, re.M):
        values = [v.strip().strip("'\"") for v in m[2].split(",") if v.strip()]
        if m[1] in _LISTS:
            out[m[1]] = [int(v) for v in values]
        elif m[1] in _NUMBERS:
            out[m[1]] = float(values[0])
        elif m[1] == "map_proj":
            out[m[1]] = values[0].upper()
    out.setdefault("truelat2", out.get("truelat1", 0.0))
    return out


def plane(params: dict) -> Plane:
    """Forward and inverse projection in metres; spherical closed forms of Mercator, Lambert and polar stereographic."""
    kind, r = params["map_proj"], SPHERE
    lon0 = math.radians(params.get("stand_lon", params["ref_lon"]))
    one, two = math.radians(params["truelat1"]), math.radians(params["truelat2"])
    half = math.pi / 4
    if kind.startswith("MERC"):
        k = r * math.cos(one)
        return (
            lambda lon, lat: (k * (math.radians(lon) - lon0), k * math.log(math.tan(half + math.radians(lat) / 2))),
            lambda x, y: (math.degrees(x / k + lon0), math.degrees(2 * math.atan(math.exp(y / k)) - math.pi / 2)),
        )
    if kind.startswith("LAMB"):
        n = math.sin(one) if abs(one - two) < 1e-9 else math.log(math.cos(one) / math.cos(two)) / math.log(math.tan(half + two / 2) / math.tan(half + one / 2))
        f = math.cos(one) * math.tan(half + one / 2) ** n / n
        rho0 = r * f / math.tan(half + math.radians(params["ref_lat"]) / 2) ** n

        def forward(lon: float, lat: float) -> tuple[float, float]:
            rho, theta = r * f / math.tan(half + math.radians(lat) / 2) ** n, n * (math.radians(lon) - lon0)
            return rho * math.sin(theta), rho0 - rho * math.cos(theta)

        def back(x: float, y: float) -> tuple[float, float]:
            rho = math.copysign(math.hypot(x, rho0 - y), n)
            theta = math.atan2(math.copysign(1, n) * x, math.copysign(1, n) * (rho0 - y))
            return math.degrees(lon0 + theta / n), math.degrees(2 * math.atan((r * f / rho) ** (1 / n)) - math.pi / 2)

        return forward, back
    if kind.startswith(("POLAR", "STERE")):
        s = math.copysign(1, params["truelat1"])
        k = r * (1 + math.sin(abs(one)))

        def stereo(lon: float, lat: float) -> tuple[float, float]:
            rho, d = k * math.tan(half - s * math.radians(lat) / 2), math.radians(lon) - lon0
            return rho * math.sin(d), -s * rho * math.cos(d)

        def unstereo(x: float, y: float) -> tuple[float, float]:
            return math.degrees(lon0 + math.atan2(x, -s * y)), math.degrees(s * (math.pi / 2 - 2 * math.atan(math.hypot(x, y) / k)))

        return stereo, unstereo
    raise ValueError(f"unknown projection {kind}")


def plane_columns(params: dict) -> tuple[Callable[[Column, Column], tuple[Column, Column]], Callable[[Column, Column], tuple[Column, Column]]]:
    """plane() over columns: metres of lon and lat, and lon and lat of metres, of whole grids; what depends on the projection alone
    is a literal. Longitudes come back within half a turn of the projection's own."""
    kind, r, half = params["map_proj"], SPHERE, math.pi / 4
    lon0 = math.radians(params.get("stand_lon", params["ref_lon"]))
    one, two = math.radians(params["truelat1"]), math.radians(params.get("truelat2", params["truelat1"]))
    apart = lambda lon: F.pmod(F.radians(lon) - lon0 + math.pi, F.lit(2 * math.pi)) - math.pi
    east = lambda angle: F.degrees(angle + lon0)
    if kind.startswith("MERC"):
        k = r * math.cos(one)
        return (
            lambda lon, lat: (k * apart(lon), k * F.log(F.tan(half + F.radians(lat) / 2))),
            lambda x, y: (east(x / k), F.degrees(2 * F.atan(F.exp(y / k)) - math.pi / 2)),
        )
    if kind.startswith("LAMB"):
        n = math.sin(one) if abs(one - two) < 1e-9 else math.log(math.cos(one) / math.cos(two)) / math.log(math.tan(half + two / 2) / math.tan(half + one / 2))
        scale = r * math.cos(one) * math.tan(half + one / 2) ** n / n
        top, sign = scale / math.tan(half + math.radians(params["ref_lat"]) / 2) ** n, math.copysign(1, n)
        rho = lambda lat: scale / F.pow(F.tan(half + F.radians(lat) / 2), F.lit(n))
        far = lambda x, y: sign * F.sqrt(x * x + (top - y) * (top - y))
        return (
            lambda lon, lat: (rho(lat) * F.sin(n * apart(lon)), top - rho(lat) * F.cos(n * apart(lon))),
            lambda x, y: (east(F.atan2(sign * x, sign * (top - y)) / n), F.degrees(2 * F.atan(F.pow(scale / far(x, y), F.lit(1 / n))) - math.pi / 2)),
        )
    if kind.startswith(("POLAR", "STERE")):
        s = math.copysign(1, params["truelat1"])
        k = r * (1 + math.sin(abs(one)))
        rho = lambda lat: k * F.tan(half - s * F.radians(lat) / 2)
        return (
            lambda lon, lat: (rho(lat) * F.sin(apart(lon)), -s * rho(lat) * F.cos(apart(lon))),
            lambda x, y: (east(F.atan2(x, -s * y)), F.degrees(s * (math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) / k)))),
        )
    raise ValueError(f"unknown projection {kind}")


def model_pixels(lon: Column, lat: Column, params: dict, domain: int = 1) -> tuple[Column, Column]:
    """Pixel coordinates (i, j; whole at the middle of cells) of positions on the projected grid of a domain."""
    row = domain_rows(params)[domain - 1]
    x, y = plane_columns(params)[0](lon, lat)
    return (x - row[3]) / row[11] - 0.5, (y - row[5]) / row[12] - 0.5


def model_lonlat(i: Column, j: Column, params: dict, domain: int = 1) -> tuple[Column, Column]:
    """Longitude and latitude of pixel coordinates: the inverse of model_pixels."""
    row = domain_rows(params)[domain - 1]
    return plane_columns(params)[1](row[3] + (i + 0.5) * row[11], row[5] + (j + 0.5) * row[12])


def domain_grid(spark, params: dict, domain: int = 1) -> DataFrame:
    """j, i, x_m, y_m, lon and lat of the cells of a domain, made by tasks."""
    row = domain_rows(params)[domain - 1]
    nx, ny = params["e_we"][domain - 1] - 1, params["e_sn"][domain - 1] - 1
    cells = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("j"), (F.col("id") % nx).cast("int").alias("i"))
    lon, lat = model_lonlat(F.col("i"), F.col("j"), params, domain)
    return cells.select("j", "i", (row[3] + (F.col("i") + 0.5) * row[11]).alias("x_m"), (row[5] + (F.col("j") + 0.5) * row[12]).alias("y_m"), lon.alias("lon"), lat.alias("lat"))


def domain_rows(params: dict) -> list[tuple]:
    """A row per domain; a child's corner is counted in its parent's cells."""
    forward, back = plane(params)
    out: list[tuple] = []
    for k, parent in enumerate(params["parent_id"]):
        nx, ny = params["e_we"][k] - 1, params["e_sn"][k] - 1
        ratio = params["parent_grid_ratio"][k]
        if k == 0:
            dx, dy = params["dx"], params["dy"]
            cx, cy = forward(params["ref_lon"], params["ref_lat"])
            x, y = cx - nx * dx / 2, cy - ny * dy / 2
        else:
            up = out[parent - 1]
            dx, dy = up[11] / ratio, up[12] / ratio
            x, y = up[3] + (params["i_parent_start"][k] - 1) * up[11], up[5] + (params["j_parent_start"][k] - 1) * up[12]
        corners = [back(a, b) for a, b in ((x, y), (x + nx * dx, y), (x + nx * dx, y + ny * dy), (x, y + ny * dy))]
        lons, lats = [c[0] for c in corners], [c[1] for c in corners]
        out.append((f"d{k + 1:02d}", parent, ratio, x, x + nx * dx, y, y + ny * dy, min(lons), max(lons), min(lats), max(lats), dx, dy))
    return out


DOMAIN = "id string, parent int, ratio int, x_min double, x_max double, y_min double, y_max double, lon_min double, lon_max double, lat_min double, lat_max double, dx double, dy double"


def domains(spark, params: dict) -> DataFrame:
    return spark.createDataFrame(domain_rows(params), DOMAIN)


def polygon_wkt() -> Column:
    """The four corners of a domain row as WKT."""
    corner = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    a, b, c, d = corner("lon_min", "lat_min"), corner("lon_max", "lat_min"), corner("lon_max", "lat_max"), corner("lon_min", "lat_max")
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", a, b, c, d, a), F.lit("))"))


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * WEB_SPHERE, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * WEB_SPHERE


def area() -> Column:
    """Square degrees of a domain row."""
    return (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min"))


def ring() -> Column:
    """The corners of a domain row as an array of (x, y)."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(corner("lon_min", "lat_min"), corner("lon_max", "lat_min"), corner("lon_max", "lat_max"), corner("lon_min", "lat_max"))


def total_bounds(df: DataFrame) -> DataFrame:
    x0, y0 = web_mercator(F.col("lon_min"), F.col("lat_min"))
    x1, y1 = web_mercator(F.col("lon_max"), F.col("lat_max"))
    return df.agg(F.min(x0).alias("x_min"), F.min(y0).alias("y_min"), F.max(x1).alias("x_max"), F.max(y1).alias("y_max"))
