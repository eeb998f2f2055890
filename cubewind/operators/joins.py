"""Joins of cubes, stations and features. Cubes are never crossed with stations: the nearest cell is found on the grid table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, latitude, longitude
STATIONS = [
    ("Cerro Crocker", -0.642398, -90.326),
    ("Cueva de Sucre", -0.843216, -91.0284),
    ("El Junco", -0.893768, -89.4804),
    ("La Galapaguera", -0.91197, -89.4387),
    ("Militar", -0.489962, -90.2808),
    ("Minas Rojas", -0.618625, -90.3673),
    ("Puerto Ayora", -0.743708, -90.3027),
    ("Puerto Baquerizo Moreno", -0.89515, -89.6068),
    ("Puerto Villamil", -0.946400, -90.9741),
    ("Santa Rosa", -0.65453, -90.4035),
    ("Sierra Negra", -0.848344, -91.1312),
    ("Bellavista", -0.696292, -90.327),
]


def stations(spark) -> DataFrame:
    return spark.createDataFrame(STATIONS, "station string, lat double, lon double")


def merge_variables(a: DataFrame, b: DataFrame, how: str = "full_outer", keys: Sequence[str] = ("time", "level", "j", "i")) -> DataFrame:
    """Variables of two cubes side by side; all coordinates of either by default."""
    keys = [k for k in keys if k in a.columns and k in b.columns]
    return a.join(b, keys, how)


def attach(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("time", "j", "i")) -> DataFrame:
    """Columns of b at all times of a; an error if b lacks a coordinate of a."""
    out = a.join(b.withColumn("_there", F.lit(True)), list(keys), "left")
    return out.where(F.coalesce("_there", F.raise_error(F.lit("a coordinate has no match")).cast("boolean"))).drop("_there")


def with_model(observed: DataFrame, model: DataFrame, how: str = "inner", on: Sequence[str] = ("ts",)) -> DataFrame:
    return observed.join(model, list(on), how)


def _distance(metric: str) -> Column:
    dlat, dlon = F.abs(F.col("lat") - F.col("_lat")), F.abs(F.col("lon") - F.col("_lon"))
    if metric == "chebyshev":
        return F.greatest(dlat, dlon)
    half = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("_lat")) * F.pow(F.sin(F.radians(dlon) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


#: Sides of bins as powers of 2, the first and the last: from well under a grid's step to all around, in degrees for the plane
#: and in radii for the sphere
PLANE_BINS, SPHERE_BINS = (-9, 10), (-14, 2)


def _places(lat: str, lon: str, metric: str) -> list[str]:
    """Coordinates in which bins are cubes: degrees, or the unit sphere's, which know neither poles nor a date line."""
    if metric == "chebyshev":
        return [lon, lat]
    return [f"(cos(radians({lat})) * cos(radians({lon})))", f"(cos(radians({lat})) * sin(radians({lon})))", f"sin(radians({lat}))"]


def _bins(places: Sequence[str], level: str) -> list[str]:
    return [f"cast(floor({p} / pow(2.0D, {level})) as bigint)" for p in places]


def _bin_tree(df: DataFrame, places: Sequence[str], levels: tuple[int, int]) -> DataFrame:
    """df with a row for each level (`_l`) and bin (`_b0`, `_b1` ...) of a place."""
    bins = ", ".join(f"'_b{k}', {x}" for k, x in enumerate(_bins(places, "l")))
    return df.selectExpr("*", f"inline(transform(sequence({levels[0]}, {levels[1]}), l -> named_struct('_l', l, {bins})))")


def _around(df: DataFrame, dimensions: int) -> DataFrame:
    """The bins beside each, too."""
    for k in range(dimensions):
        rest = [c for c in df.columns if c != f"_b{k}"]
        df = df.selectExpr(*rest, f"explode(array(_b{k} - 1, _b{k}, _b{k} + 1)) AS _b{k}")
    return df


def nearest_cell(points: DataFrame, grid: DataFrame, metric: str = "chebyshev") -> DataFrame:
    """station, j, i, dist of the cell that is nearest to each point, in degrees ('chebyshev') or along the sphere in radians;
    of equal distances the least (j, i). One plan without a loop: cells are in a tree of bins, each level twice as wide as the one
    below. A point's first level with a cell in the bins around its own bounds how far the nearest can be, and the bins around
    that are wide enough hold it. Joins are equi-joins on bins; only distinct places are looked up.

    Each row of points comes out once, whatever names repeat or are NULL; without coordinates or cells j, i and dist are NULL."""
    levels, up = (PLANE_BINS, 1) if metric == "chebyshev" else (SPHERE_BINS, 2)
    fine = "{0} IS NOT NULL AND NOT isnan({0}) AND {1} IS NOT NULL AND NOT isnan({1})"
    cells = grid.where(fine.format("lat", "lon")).selectExpr("j", "i", "cast(lat as double) AS lat", "cast(lon as double) AS lon")
    own = points.selectExpr("station", "cast(lat as double) AS _lat", "cast(lon as double) AS _lon")
    asked = own.where(fine.format("_lat", "_lon")).select("_lat", "_lon").distinct()
    here, there = _places("_lat", "_lon", metric), _places("lat", "lon", metric)
    key = ["_l", *[f"_b{k}" for k in range(len(here))]]
    tree = _bin_tree(cells, there, levels)
    first = _around(_bin_tree(asked, here, levels), len(here)).join(tree.select(*key), key, "left_semi").groupBy("_lat", "_lon").agg(F.min("_l").alias("_first"))
    # what the first level has is within two sides of the point in each coordinate, so the nearest cell is within one of `up` levels higher
    at = first.selectExpr("_lat", "_lon", f"least(_first + {up}, {levels[1]}) AS _l")
    wide = _around(at.selectExpr("*", *[f"{x} AS _b{k}" for k, x in enumerate(_bins(here, "_l"))]), len(here))
    best = wide.join(tree, key).groupBy("_lat", "_lon").agg(F.min(F.struct(_distance(metric).alias("dist"), "j", "i")).alias("_b"))
    return own.join(best, ["_lat", "_lon"], "left").select("station", "_b.j", "_b.i", "_b.dist")


def nearest_series(cube: DataFrame, points: DataFrame, grid: DataFrame, variable: str) -> DataFrame:
    cells = nearest_cell(points, grid)
    return cube.join(cells, ["j", "i"]).select("station", "time", variable)


def match_station(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Stations whose last word is in a name, both in lower case. A name asks for its pieces of the lengths that last words have,
    so that it is an equi-join; every row of names comes out, without a station if there is none. The catalogue is what is
    broadcast, never pieces or what was found for names."""
    key = F.lower(F.element_at(F.split("station", " "), -1))
    known = catalogue.withColumn("_k", key).where(F.length("_k") > 0)
    lengths = known.agg(F.collect_set(F.length("_k")).alias("_n"))  # one row, a few numbers
    low = F.lower("name")
    pieces = F.array_distinct(F.flatten(F.transform("_n", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda a: F.substring(low, a, n)))))
    asked = names.select("name").where("name IS NOT NULL").distinct().join(F.broadcast(lengths)).select("name", F.explode(pieces).alias("_k"))
    return names.join(asked.join(F.broadcast(known), "_k").drop("_k").hint("merge"), "name", "left")


def merged_sensors(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def features_in_boxes(features: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """Points in boxes (id, lon_min, lon_max, lat_min, lat_max), by cells of a coarse grid, so that it is an equi-join."""
    f = features.withColumn("_x", F.floor(F.col("lon") / cell)).withColumn("_y", F.floor(F.col("lat") / cell))
    span = lambda a, z: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(z) / cell))
    b = boxes.withColumn("_x", F.explode(span("lon_min", "lon_max"))).withColumn("_y", F.explode(span("lat_min", "lat_max")))
    inside = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
    return f.join(b, ["_x", "_y"]).where(inside).drop("_x", "_y")


def _edges(rings: Column) -> Column:
    """All edges of some rings (arrays of struct x, y; whether the first point comes again at the end doesn't matter)."""
    return F.flatten(F.transform(rings, lambda r: F.arrays_zip(r.alias("a"), F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)).alias("b"))))


def _inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a point is inside, by the parity of crossings with all edges: holes are outside, islands in them inside."""
    crossed = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.size(F.filter(edges, crossed)) % 2 == 1


def _segments(points: Column) -> Column:
    return F.arrays_zip(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.size(points)).alias("b"))


def _side(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def _meet(s: Column, e: Column) -> Column:
    """Whether two segments meet; those on one line do if their boxes do."""
    boxes = [F.greatest(F.least(s["a"][c], s["b"][c]), F.least(e["a"][c], e["b"][c])) <= F.least(F.greatest(s["a"][c], s["b"][c]), F.greatest(e["a"][c], e["b"][c])) for c in ("x", "y")]
    return boxes[0] & boxes[1] & (_side(s["a"], s["b"], e["a"]) * _side(s["a"], s["b"], e["b"]) <= 0) & (_side(e["a"], e["b"], s["a"]) * _side(e["a"], e["b"], s["b"]) <= 0)


def features_in_polygons(features: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """Lines or points (`points`, array of struct x, y) that meet polygons: id and `ring`, or `rings` with holes and islands.
    Both are dealt to coarse cells that their boxes touch, so that it is an equi-join; each pair is tested once."""
    many = "rings" in polygons.columns

    def dealt(df: DataFrame, points: Column, key: str) -> DataFrame:
        low, high = (lambda c, f=f: F.floor(f(F.transform(points, lambda p: p[c])) / cell) for f in (F.array_min, F.array_max))
        span = lambda c: F.explode(F.sequence(low(c), high(c)))
        return df.withColumn(key, F.monotonically_increasing_id()).withColumn("_x", span("x")).withColumn("_y", span("y"))

    outline = F.flatten("rings") if many else F.col("ring")
    pairs = dealt(features, F.col("points"), "_f").join(dealt(polygons, outline, "_p"), ["_x", "_y"]).dropDuplicates(["_f", "_p"])
    line = F.col("points")
    pairs = pairs.withColumn("_edges", _edges(F.col("rings") if many else F.array("ring")))
    inside = F.exists(line, lambda p: _inside(p["x"], p["y"], F.col("_edges")))
    crossing = F.exists(_segments(line), lambda s: F.exists("_edges", lambda e: _meet(s, e)))
    return pairs.where(inside | crossing).drop("_f", "_p", "_x", "_y", "_edges")


def points_in_areas(points: DataFrame, areas: DataFrame, cell: float = 0.25) -> DataFrame:
    """Points (lon, lat) with the id of each area (id, `rings`, with holes and islands) that they lie in, by the parity of
    crossings with the edges to their east. Edges are dealt to slabs of `cell` degrees of latitude, and points meet those of the
    areas whose box they are in, so a coast of any length is no single row that each point has to walk along. Joins are
    equi-joins; repeated points come out as often, points in no area don't."""
    edges = areas.select("id", F.explode(_edges(F.col("rings"))).alias("_e")).select("id", F.col("_e.a.x").alias("_x1"), F.col("_e.a.y").alias("_y1"), F.col("_e.b.x").alias("_x2"), F.col("_e.b.y").alias("_y2"))
    edges = edges.where("_y1 <> _y2")  # level edges are never crossed
    slab = lambda c: F.floor(c / cell).cast("long")
    boxes = edges.groupBy("id").agg(F.min(F.least("_x1", "_x2")).alias("_w"), F.max(F.greatest("_x1", "_x2")).alias("_o"), F.min(F.least("_y1", "_y2")).alias("_s"), F.max(F.greatest("_y1", "_y2")).alias("_n"))
    wide = boxes.withColumn("_b", F.explode(F.sequence(F.floor("_w"), F.floor("_o")))).withColumn("_c", F.explode(F.sequence(F.floor("_s"), F.floor("_n"))))
    places = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(F.col("lon").cast("double").alias("_lon"), F.col("lat").cast("double").alias("_lat")).distinct()
    near = places.withColumns({"_b": F.floor("_lon"), "_c": F.floor("_lat")}).join(wide, ["_b", "_c"]).where("_lon >= _w AND _lon <= _o AND _lat >= _s AND _lat <= _n").select("_lon", "_lat", "id", slab(F.col("_lat")).alias("_k"))
    dealt = edges.withColumn("_k", F.explode(F.sequence(slab(F.least("_y1", "_y2")), slab(F.greatest("_y1", "_y2")))))
    crossed = "(_y1 > _lat) <> (_y2 > _lat) AND _lon < (_x2 - _x1) * (_lat - _y1) / (_y2 - _y1) + _x1"
    inside = near.join(dealt, ["id", "_k"]).where(crossed).groupBy("_lon", "_lat", "id").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    return points.join(inside.select(F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), "id"), ["lon", "lat"]).select(*points.columns, "id")


def points_in_polygon(points: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Points (lon, lat) inside a polygon, by the parity of crossings; a plain expression over the edges."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > F.col("lat")) != (F.lit(y2) > F.col("lat"))
            at = (x2 - x1) * (F.col("lat") - y1) / (y2 - y1) + x1
            crossings = crossings + F.when(spans & (F.col("lon") < at), 1).otherwise(0)
    return points.where(crossings % 2 == 1)
