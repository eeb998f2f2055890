"""Regular grids, interpolation between them, and elevation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lonlat_grid(spark, xsize: int, ysize: int, xfirst: float, xinc: float, yfirst: float, yinc: float) -> DataFrame:
    """j, i, lon, lat of a regular grid; cells are made by tasks, not by the driver."""
    cell = spark.range(xsize * ysize)
    j, i = F.floor(F.col("id") / xsize).cast("int"), (F.col("id") % xsize).cast("int")
    return cell.select(j.alias("j"), i.alias("i")).withColumn("lon", F.lit(xfirst) + F.col("i") * F.lit(xinc)).withColumn("lat", F.lit(yfirst) + F.col("j") * F.lit(yinc))


def parse_grid_description(text: str) -> dict[str, float | str]:
    """key = value lines of a grid description."""
    out: dict[str, float | str] = {}
    for line in text.splitlines():
        key, eq, value = (x.strip() for x in line.partition("="))
        if eq:
            out[key] = value if key == "gridtype" else int(value) if key in ("xsize", "ysize") else float(value)
    return out


def linspace_grid(spark, lon: tuple[float, float], lat: tuple[float, float], nx: int, ny: int) -> DataFrame:
    return lonlat_grid(spark, nx, ny, lon[0], (lon[1] - lon[0]) / (nx - 1), lat[0], (lat[1] - lat[0]) / (ny - 1))


def _repeated(points: DataFrame) -> DataFrame:
    """Distinct points and how often each is there (`_times`): repeated rows are interpolated once and come out as often."""
    return points.groupBy(*points.columns).agg(F.count(F.lit(1)).cast("int").alias("_times"))


def _from_cells(points: DataFrame, raster: DataFrame, value: str, corners: list[tuple[int, int]], weight, complete) -> DataFrame:
    """Weighted sums of raster cells around points: _x and _y in cells. weight and complete: of a corner, of all corners."""
    columns = [c for c in points.columns if c not in ("_x", "_y")]
    offsets = F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj, di in corners])
    wide = points.withColumn("_c", F.explode(offsets)).withColumn("_rj", F.floor("_y").cast("int") + F.col("_c.dj")).withColumn("_ri", F.floor("_x").cast("int") + F.col("_c.di"))
    wide = wide.withColumn("_w", weight(F.col("_x") - F.col("_ri")) * weight(F.col("_y") - F.col("_rj"))).select(*columns, "_rj", "_ri", "_w")
    cells = raster.select(F.col("j").alias("_rj"), F.col("i").alias("_ri"), F.col(value).alias("_v"))
    both = wide.join(cells, ["_rj", "_ri"], "left").groupBy(*columns)
    out = both.agg(F.when(complete, F.sum(F.when(F.col("_w") == 0, 0.0).otherwise(F.col("_w") * F.col("_v")))).alias(value))
    return out.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def bilinear(points: DataFrame, raster: DataFrame, value: str, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """points (with lon, lat) and the value between the four raster cells (j, i) around each; NULL outside or where one is
    missing. An equi-join on cell numbers: each distinct point asks for four cells, and repeated points come out repeated."""
    x, y = pixels(F.col("lon"), F.col("lat"), origin, step)
    at = _repeated(points).withColumns({"_x": x, "_y": y})
    # a corner of weight 0 may be outside
    some = F.count(F.when(F.col("_v").isNotNull() | (F.col("_w") == 0), 1)) == 4
    return _from_cells(at, raster, value, [(dj, di) for dj in (0, 1) for di in (0, 1)], lambda d: 1 - F.abs(d), some)


def bilinear_weights(target: DataFrame, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """target (keys, lon, lat) with the four source cells (j, i) of each point and their weights. Written once, they serve all
    files of a grid."""
    keys = [c for c in target.columns if c not in ("lon", "lat")]
    at = target.withColumn("_x", (F.col("lon") - origin[0]) / step[0]).withColumn("_y", (F.col("lat") - origin[1]) / step[1])
    corners = F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj in (0, 1) for di in (0, 1)])
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    wide = at.select(*keys, "_x", "_y", fx.alias("_fx"), fy.alias("_fy"), F.explode(corners).alias("_c"))
    weight = F.when(F.col("_c.di") == 1, F.col("_fx")).otherwise(1 - F.col("_fx")) * F.when(F.col("_c.dj") == 1, F.col("_fy")).otherwise(1 - F.col("_fy"))
    return wide.select(*keys, (F.floor("_y") + F.col("_c.dj")).cast("int").alias("j"), (F.floor("_x") + F.col("_c.di")).cast("int").alias("i"), weight.alias("weight"))


#: Points this far outside a quadrilateral, in its own coordinates, still lie in it, as rounding may have moved them
EDGE = 1e-9


def quadrilaterals(grid: DataFrame) -> DataFrame:
    """_qj, _qi and the corners (x00 ... y11) of the quadrilaterals between neighbouring cells (j, i, lon, lat) of any grid; those
    with a missing corner aren't there. A cell is a corner of four, which are put together by one shuffle."""
    corner = F.explode(F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di")) for dj in (0, 1) for di in (0, 1)])).alias("_c")
    wide = grid.where("lon IS NOT NULL AND lat IS NOT NULL").select("j", "i", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), corner)
    of = lambda c, dj, di: F.max(F.when((F.col("_c.dj") == dj) & (F.col("_c.di") == di), F.col(c)))
    sides = [of(c, dj, di).alias(f"{n}{dj}{di}") for n, c in (("x", "lon"), ("y", "lat")) for dj in (0, 1) for di in (0, 1)]
    quads = wide.groupBy((F.col("j") - F.col("_c.dj")).alias("_qj"), (F.col("i") - F.col("_c.di")).alias("_qi")).agg(F.count(F.lit(1)).alias("_n"), *sides)
    return quads.where("_n = 4").drop("_n")


def _inverse_bilinear(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and where (_px, _py) lies between the corners of a quadrilateral: _u and _v, from 0 to 1 along i and j. Pairs where it
    lies elsewhere are left out. In steps, so that what is used often is computed once."""
    c = F.col
    names = ("ex", "ey", "fx", "fy", "gx", "gy", "hx", "hy")
    sides = (c("x01") - c("x00"), c("y01") - c("y00"), c("x10") - c("x00"), c("y10") - c("y00"), c("x00") - c("x01") - c("x10") + c("x11"), c("y00") - c("y01") - c("y10") + c("y11"), c("_px") - c("x00"), c("_py") - c("y00"))
    out = pairs.select(*keep, *[x.alias(n) for n, x in zip(names, sides, strict=True)])
    k2, k1, k0 = c("gx") * c("fy") - c("gy") * c("fx"), c("ex") * c("fy") - c("ey") * c("fx") + c("hx") * c("gy") - c("hy") * c("gx"), c("hx") * c("ey") - c("hy") * c("ex")
    out = out.withColumns({"k2": k2, "k1": k1, "k0": k0})
    root = F.sqrt(F.greatest(c("k1") * c("k1") - 4 * c("k0") * c("k2"), F.lit(0.0)))
    out = out.withColumn("q", -0.5 * (c("k1") + F.when(c("k1") < 0, -1.0).otherwise(1.0) * root))
    out = out.withColumn("_v", F.explode(F.array(c("k0") / F.nullif(c("q"), F.lit(0.0)), c("q") / F.nullif(c("k2"), F.lit(0.0)))))  # both roots
    inside = lambda x: x.between(-EDGE, 1 + EDGE)
    out = out.where(inside(c("_v"))).withColumns({"dx": c("ex") + c("gx") * c("_v"), "dy": c("ey") + c("gy") * c("_v")})
    flat = F.abs("dx") > F.abs("dy")
    out = out.withColumn("_u", F.when(flat, c("hx") - c("fx") * c("_v")).otherwise(c("hy") - c("fy") * c("_v")) / F.nullif(F.when(flat, c("dx")).otherwise(c("dy")), F.lit(0.0)))
    return out.where(inside(c("_u"))).select(*keep, "_u", "_v")


def curvilinear_weights(target: DataFrame, grid: DataFrame, cell: float) -> DataFrame:
    """As bilinear_weights, but from a grid whose cells have any lon and lat: target (keys, lon, lat) with the four source cells
    (j, i) around each point and their weights, by inverse bilinear mapping. Quadrilaterals and points meet in bins of `cell`
    degrees (a few steps of the grid), by an equi-join; of those that share a point the least (j, i) takes it. Targets outside
    come out once, with NULL for j, i and weight, so that they can't get lost."""
    keys = [c for c in target.columns if c not in ("lon", "lat")]
    number = lambda c: F.floor(c / cell).cast("long")
    xs, ys = (F.array(*[F.col(f"{n}{dj}{di}") for dj in (0, 1) for di in (0, 1)]) for n in "xy")
    quads = quadrilaterals(grid)
    span = lambda v: F.explode(F.sequence(number(F.array_min(v) - EDGE * cell), number(F.array_max(v) + EDGE * cell)))
    quads = quads.withColumn("_bx", span(xs)).withColumn("_by", span(ys))
    places = target.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("lon").cast("double").alias("_px"), F.col("lat").cast("double").alias("_py")).distinct()
    met = places.withColumns({"_bx": number(F.col("_px")), "_by": number(F.col("_py"))}).join(quads, ["_bx", "_by"])
    one = _inverse_bilinear(met, ["_px", "_py", "_qj", "_qi"]).groupBy("_px", "_py").agg(F.min(F.struct("_qj", "_qi", "_u", "_v")).alias("_q"))
    share = lambda c, d: F.greatest(F.least(F.col(f"_q.{c}") if d else 1 - F.col(f"_q.{c}"), F.lit(1.0)), F.lit(0.0))
    corners = F.array(*[F.struct((F.col("_q._qj") + dj).cast("int").alias("j"), (F.col("_q._qi") + di).cast("int").alias("i"), (share("_v", dj) * share("_u", di)).alias("weight")) for dj in (0, 1) for di in (0, 1)])
    found = one.select("_px", "_py", F.inline(corners))
    both = target.join(found, (target["lon"].cast("double") == found["_px"]) & (target["lat"].cast("double") == found["_py"]), "left")
    return both.select(*keys, "j", "i", "weight")


def remap(cube: DataFrame, weights: DataFrame, variable: str) -> DataFrame:
    """All files and times of a cube on another grid: keys of the weights' target, the cube's other coordinates and the variable,
    for every target at every coordinate; NULL where one of the cells of weight is missing or the target lies outside."""
    keys = [c for c in weights.columns if c not in ("j", "i", "weight")]
    others = [c for c in cube.columns if c in ("file", "time", "level")]
    own = weights.where("weight <> 0")
    got = cube.join(own, ["j", "i"]).groupBy(*others, *keys).agg(F.sum(F.col("weight") * F.col(variable)).alias(variable), F.count(variable).alias("_n"))
    need = weights.groupBy(*keys).agg(F.count(F.when(F.col("weight") != 0, 1)).alias("_need"))
    every = need.crossJoin(cube.select(*others).distinct()) if others else need  # the rows of the result, not of a join's input
    same = [every[k].eqNullSafe(got[k]) for k in (*others, *keys)]
    met = every.join(got, same, "left")
    return met.select(*[every[k] for k in (*others, *keys)], F.when((F.col("_n") == F.col("_need")) & (F.col("_need") > 0), F.col(variable)).alias(variable))


def pixels(x: Column, y: Column, origin: tuple[float, float], step: tuple[float, float]) -> tuple[Column, Column]:
    """Pixel coordinates of positions on a regular grid."""
    return (x - origin[0]) / step[0], (y - origin[1]) / step[1]


def transform_nearest(target: DataFrame, source: DataFrame, value: str, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """target (with lon, lat) and the value of the source cell that each point lies in; NULL outside."""
    x, y = pixels(F.col("lon"), F.col("lat"), origin, step)
    cells = source.select(F.col("j").alias("_sj"), F.col("i").alias("_si"), value)
    at = target.withColumn("_sj", F.floor(y + 0.5).cast("int")).withColumn("_si", F.floor(x + 0.5).cast("int"))
    return at.join(cells, ["_sj", "_si"], "left").drop("_sj", "_si")


def cubic_weight(d: Column) -> Column:
    """Catmull-Rom."""
    a = F.abs(d)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4 * a + 2).otherwise(0.0)


def bicubic(points: DataFrame, raster: DataFrame, value: str, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """The same from sixteen cells; NULL unless all are there."""
    x, y = pixels(F.col("lon"), F.col("lat"), origin, step)
    at = _repeated(points).withColumns({"_x": x, "_y": y})
    return _from_cells(at, raster, value, [(dj, di) for dj in range(-1, 3) for di in range(-1, 3)], cubic_weight, F.count("_v") == 16)


def synthetic_elevation(grid: DataFrame, lon: tuple[float, float], lat: tuple[float, float], land: bool = True) -> DataFrame:
    """Waves over a grid, with a hill in the middle (land) or a constant; without noise."""
    wave = lambda a, k: a * F.sin(F.col("lon") * k) * F.cos(F.col("lat") * k)
    third = lambda a: a * F.sin(F.col("lon") / 3) * F.cos(F.col("lat") / 3)
    if land:
        far = F.sqrt(F.pow(F.col("lon") - (lon[0] + lon[1]) / 2, 2) + F.pow(F.col("lat") - (lat[0] + lat[1]) / 2, 2))
        e = third(1200) + wave(600, 1.5) + wave(300, 4) + 1500 * F.exp(-far / 2)
    else:
        e = third(800) + wave(400, 1.5) + wave(200, 4) + 500
    return grid.withColumn("elevation", e)


def static_elevation(hgt: DataFrame, landmask: DataFrame) -> DataFrame:
    return hgt.join(landmask, ["j", "i"]).select("j", "i", (F.col("hgt") * F.col("landmask")).alias("elevation"))


def elevation_source(resolution_m: float, domain: int, statics: tuple[str, ...] = ("d01", "d02")) -> list[str]:
    """Sources to try, in order, for a domain (from 0) at a resolution."""
    own = [f"static:{statics[domain]}"] if domain < len(statics) else []
    return [*own, *(["SRTM3"] if resolution_m / 111000 < 0.05 else []), "GMTED2010:0.0625", "synthetic"]


def nearest_resolution(files: dict[float, str], wanted: float) -> str:
    return files[min(files, key=lambda r: (abs(r - wanted), r))]


def zoom(span: Column) -> Column:
    """Zoom level of map tiles for a span in degrees."""
    z = 6 + F.log2(F.greatest(360 / F.greatest(span, F.lit(1e-6)), F.lit(1.0)))
    return F.floor(F.greatest(F.least(z, F.lit(14.0)), F.lit(1.0))).cast("int")


def degrees_of(metres: Column, lat: Column) -> tuple[Column, Column]:
    """Resolution in degrees of longitude and latitude."""
    return metres / 111000 / F.cos(F.radians(lat)), metres / 111000
