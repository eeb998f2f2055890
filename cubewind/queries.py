"""Queries over the driver's tables, each with the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.functions import calendar, names, thermo, units
from cubewind.operators import domains, enso, joins, masks, reduce, regression, regrid, select, series
from cubewind.plans import trends
from cubewind.sources import files
from cubewind.views import CTE, NI, NJ, cube, field, grid, index, observations, places, sites, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that follows the common views."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = CTE + sql if not sql.lstrip().upper().startswith("WITH") else sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


START, END = "1996-01-01", "2000-12-31"
_SLICE = f"\"time\" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
_CROP = "j BETWEEN 1 AND 8 AND i BETWEEN 1 AND 18"
_FIT = "regr_count(y, x) AS n, round(regr_slope(y, x), 9) + 0.0 AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2"


def _spec(kind: str, **kw) -> trends.Spec:
    return trends.Spec(**({"kind": kind, "variables": ["v"], "size": (NJ, NI), "start": START, "end": END, "margin": 1, "low": 100, "high": 2000} | kw))


def _fit(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, F.col("n").cast("long").alias("n"), (F.round("slope", 9) + 0.0).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


_MASKED = f"""
, masked AS (SELECT c."time", c.j, c.i, CASE WHEN hgt BETWEEN 100 AND 2000 AND landmask > 0 THEN v END AS v, CASE WHEN hgt BETWEEN 100 AND 2000 AND landmask > 0 THEN w END AS w
             FROM cube c LEFT JOIN grid g ON c.j = g.j AND c.i = g.i WHERE {_SLICE.replace('"time"', 'c."time"')} AND c.j BETWEEN 1 AND 8 AND c.i BETWEEN 1 AND 18),
sp AS (SELECT "time", avg(v) AS v, avg(w) AS w FROM masked GROUP BY 1),
sy AS (SELECT quarter("time") AS season, year("time") AS year, avg(v) AS v, avg(w) AS w FROM sp GROUP BY 1, 2),
yy AS (SELECT year("time") AS year, avg(v) AS v, avg(w) AS w FROM sp GROUP BY 1)
"""


# fits
@query(_MASKED + f"SELECT CAST(season AS INT) AS season, {_FIT.replace('y, x', 'v, year')} FROM sy GROUP BY season")
def seasonal_trend(spark, d):
    return _fit(trends.run(cube(spark, d), grid(spark), _spec("timeseries")), "season")


@query(_MASKED + f"SELECT {_FIT.replace('y, x', 'v, year')} FROM yy")
def full_year_trend(spark, d):
    return _fit(trends.run(cube(spark, d), grid(spark), _spec("full_year")))


@query(_MASKED + f"SELECT CAST(season AS INT) AS season, {_FIT.replace('y, x', 'w, v')} FROM sy GROUP BY season")
def cross_variable_regression(spark, d):
    return _fit(trends.run(cube(spark, d), grid(spark), _spec("regression", variables=["v", "w"])), "season")


@query(_MASKED + "SELECT j, i, round(avg(v), 4) AS v FROM masked GROUP BY 1, 2")
def mean_map(spark, d):
    return rounded(trends.run(cube(spark, d), grid(spark), _spec("map")), 4, "v")


# selection
@query(f'SELECT count(*) AS n, round(sum(v), 2) AS v, CAST(max("time") AS DATE) AS last_day FROM cube WHERE {_SLICE}')
def time_slice_inclusive(spark, d):
    return select.time_slice(cube(spark, d), START, END).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"), F.to_date(F.max("time")).alias("last_day"))


@query("""SELECT count(*) AS n, round(sum(v), 2) AS v FROM cube WHERE "time" >= TIMESTAMP '1996-03-01' AND "time" < TIMESTAMP '1996-04-01'""")
def date_slice_whole_days(spark, d):
    return select.date_slice(cube(spark, d), "1996-03-01", "1996-03-31").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query('SELECT j, i, "time", v FROM cube WHERE level = 3')
def level_select(spark, d):
    return select.level(cube(spark, d), 3).select("j", "i", "time", "v")


@query("""SELECT "time", j, i, round(max(CASE WHEN level = 2 THEN v END) - max(CASE WHEN level = 1 THEN v END), 4) AS v
FROM cube WHERE level IN (1, 2) GROUP BY 1, 2, 3 HAVING count(DISTINCT level) = 2""")
def level_difference(spark, d):
    return rounded(select.level_difference(cube(spark, d), "v", 1, 2), 4, "v")


@query(f"SELECT j, i, count(*) AS n FROM cube WHERE {_CROP} GROUP BY 1, 2")
def crop_margins(spark, d):
    return select.crop(cube(spark, d), (NJ, NI), 1).groupBy("j", "i").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, min(j) AS j0, max(i) AS i1 FROM cube WHERE j BETWEEN 3 AND 6 AND i BETWEEN 3 AND 16")
def remove_boundaries(spark, d):
    return select.crop(cube(spark, d), (NJ, NI), 3).agg(F.count(F.lit(1)).alias("n"), F.min("j").alias("j0"), F.max("i").alias("i1"))


@query("""SELECT j, i, level, v FROM cube WHERE "time" = (SELECT min("time") FROM cube) AND j >= 1 AND (j - 1) % 2 = 0 AND i >= 1 AND (i - 1) % 2 = 0""")
def stride_subsample(spark, d):
    return select.stride(cube(spark, d), 1, 2).select("j", "i", "level", "v")


@query("SELECT CAST(month(\"time\") AS INT) AS month, count(*) AS n FROM cube WHERE month(\"time\") IN (12, 1, 2) GROUP BY 1")
def month_triple(spark, d):
    return select.months(cube(spark, d), 12, 1, 2).groupBy(F.month("time").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query('SELECT count(*) AS n FROM cube WHERE "time" IN (SELECT "time" FROM cube WHERE level = 7)')
def same_times(spark, d):
    return select.same_times(cube(spark, d), select.level(cube(spark, d), 7)).agg(F.count(F.lit(1)).alias("n"))


@query('SELECT i, count(*) AS n, round(sum(v), 2) AS v FROM (SELECT i, "time", v, dense_rank() OVER (PARTITION BY i ORDER BY "time") AS k FROM cube) WHERE k <= 24 GROUP BY 1')
def first_day_of_run(spark, d):
    """The first 24 time steps of each column of cells."""
    return select.first_steps(cube(spark, d), 24, ["i"]).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"))


@query("SELECT j, i, hgt FROM field WHERE landmask IS NOT NULL AND landmask <> 0 AND lon BETWEEN -91.25 AND -90.75 AND lat BETWEEN -1.45 AND -1.15")
def marked_in_box(spark, d):
    return select.marked(select.box(field(spark, d), (-91.2, -90.8), (-1.4, -1.2), 0.05), "landmask").select("j", "i", "hgt")


# masks
def _masked(sql: str) -> str:
    return f"SELECT c.j, c.i, count(*) AS n, count(CASE WHEN {sql} THEN v END) AS n_v, round(sum(CASE WHEN {sql} THEN w END), 2) AS w FROM cube c JOIN grid g ON c.j = g.j AND c.i = g.i GROUP BY 1, 2"


def _mask_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("j", "i").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_v"), F.round(F.sum("w"), 2).alias("w"))


@query(_masked("hgt BETWEEN 100 AND 2000 AND landmask > 0"))
def mask_height_zone(spark, d):
    return _mask_counts(masks.height_zone(cube(spark, d), grid(spark), 100, 2000))


@query(_masked("landmask = 0"))
def mask_sea(spark, d):
    return _mask_counts(masks.mask_sea(cube(spark, d), grid(spark)))


@query(_masked("landmask = 1"))
def mask_ocean(spark, d):
    return _mask_counts(masks.mask_ocean(cube(spark, d), grid(spark)))


@query(_masked("hgt >= 100 AND hgt < 900"))
def height_zone_half_open(spark, d):
    return _mask_counts(masks.half_open_zone(cube(spark, d), grid(spark), 100, 900))


@query("""SELECT CAST(CASE WHEN hgt >= 0 AND hgt < 100 THEN 1 WHEN hgt >= 100 AND hgt < 900 THEN 2 ELSE 3 END AS INT) AS zone, round(avg(v), 4) AS mean_v, round(avg(w), 6) AS mean_w
FROM cube c JOIN grid g ON c.j = g.j AND c.i = g.i GROUP BY 1""")
def height_zone_means(spark, d):
    return rounded(rounded(masks.zone_means(cube(spark, d), grid(spark), [0, 100, 900, 2500], ["v", "w"]), 4, "mean_v"), 6, "mean_w")


@query("SELECT j, i, CAST(CASE WHEN landmask > 0 THEN CASE WHEN hgt < 100 THEN 1 WHEN hgt < 900 THEN 2 ELSE 3 END END AS INT) AS class FROM field")
def height_class(spark, d):
    return field(spark, d).select("j", "i", masks.altitude_class(F.col("hgt"), F.col("landmask")).alias("class"))


# reductions
@query('SELECT "time", level, round(avg(v), 7) AS v FROM cube GROUP BY 1, 2')
def spatial_mean_series(spark, d):
    return rounded(reduce.spatial_mean(cube(spark, d), ["v"]), 7, "v")


@query("SELECT j, i, round(avg(v), 7) AS v FROM cube GROUP BY 1, 2")
def temporal_mean_map(spark, d):
    return rounded(reduce.temporal_mean(cube(spark, d), ["v"]), 7, "v")


@query('SELECT CAST(year("time") AS INT) AS year, round(avg(v), 4) AS v, round(avg(w), 6) AS w FROM cube GROUP BY 1')
def yearly_mean(spark, d):
    return rounded(rounded(reduce.yearly_mean(cube(spark, d), ["v", "w"]), 4, "v"), 6, "w")


@query('SELECT CAST(quarter("time") AS INT) AS season, CAST(year("time") AS INT) AS year, round(avg(v), 4) AS v FROM cube GROUP BY 1, 2')
def season_year_mean(spark, d):
    return rounded(reduce.season_year_mean(cube(spark, d), ["v"]), 4, "v")


@query('SELECT CAST(CASE WHEN month("time") IN (12, 1, 2, 3, 4, 5) THEN 1 ELSE 2 END AS INT) AS dry_wet, round(avg(v), 4) AS v FROM cube GROUP BY 1')
def dry_wet_mean(spark, d):
    return rounded(reduce.dry_wet_mean(cube(spark, d), ["v"]), 4, "v")


@query("""SELECT CAST(y AS INT) AS year, round(m * (make_date(y + 1, 1, 1) - make_date(y, 1, 1)), 2) AS v FROM (SELECT year("time") AS y, avg(v) AS m FROM cube GROUP BY 1)""")
def yearly_total(spark, d):
    return rounded(reduce.yearly_total(reduce.yearly_mean(cube(spark, d), ["v"]), ["v"]), 2, "v")


@query("""SELECT CAST(s AS INT) AS season, CAST(y AS INT) AS year, round(m * (CASE WHEN s = 4 THEN make_date(y + 1, 1, 1) ELSE make_date(y, s * 3 + 1, 1) END - make_date(y, s * 3 - 2, 1)), 2) AS v
FROM (SELECT quarter("time") AS s, year("time") AS y, avg(v) AS m FROM cube GROUP BY 1, 2)""")
def season_total(spark, d):
    return rounded(reduce.season_total(reduce.season_year_mean(cube(spark, d), ["v"]), ["v"]), 2, "v")


@query("SELECT min(x_m) AS GRID_X00, min(y_m) AS GRID_Y00, min(x_m) AS GRID_X01, max(y_m) AS GRID_Y01, count(DISTINCT x_m) AS GRID_NX, count(DISTINCT y_m) AS GRID_NY FROM field")
def grid_metadata(spark, d):
    return reduce.grid_metadata(field(spark, d))


@query("SELECT round(sum(CASE WHEN sensor = 'click' THEN value END), 4) AS click, round(sum(CASE WHEN sensor = 'view' THEN value END), 4) AS view_ FROM obs")
def gauge_sums(spark, d):
    wide = observations(spark, d).select(*[F.when(F.col("sensor") == s, F.col("value")).alias(c) for s, c in (("click", "click"), ("view", "view_"))], F.lit(0.0).alias("last"))
    return rounded(files.gauge_sums(wide), 4, "click", "view_")


@query('SELECT round(avg(w) * 24 * 365, 4) AS w FROM cube')
def annualised_rate(spark, d):
    return cube(spark, d).agg(F.round(reduce.annual_rate(F.avg("w")), 4).alias("w"))


@query('SELECT j, i, round(sum(w) * 1000, 4) AS w FROM cube GROUP BY 1, 2')
def total_precipitation(spark, d):
    return rounded(reduce.total_precipitation(cube(spark, d), "w"), 4, "w")


@query('SELECT "time", j, i, round(avg(w), 6) AS w FROM cube GROUP BY 1, 2, 3')
def level_mean(spark, d):
    return rounded(reduce.level_mean(cube(spark, d), ["w"]), 6, "w")


@query("""SELECT CASE WHEN month("time") IN (12, 1, 2) THEN 'DJF' WHEN month("time") < 6 THEN 'MAM' WHEN month("time") < 9 THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM cube GROUP BY 1""")
def season_labels(spark, d):
    return cube(spark, d).groupBy(calendar.season_label(F.col("time")).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT year, month, CAST(day(last_day(make_date(year, month, 1))) AS INT) AS days, len(generate_series(CAST(make_date(year, month, 1) AS TIMESTAMP), CAST(last_day(make_date(year, month, 1)) AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hours
FROM (SELECT DISTINCT CAST(year("time") AS INT) AS year, CAST(month("time") AS INT) AS month FROM cube)""")
def month_hours(spark, d):
    months = cube(spark, d).select(F.year("time").alias("year"), F.month("time").alias("month")).distinct()
    hours = calendar.hours_of_month(F.col("year"), F.col("month"))
    return months.select("year", "month", calendar.month_length(F.col("year"), F.col("month")).alias("days"), F.size(hours).cast("long").alias("hours"))


@query(""", c AS (SELECT "time", j, i, avg(v) AS v FROM cube GROUP BY 1, 2, 3), n AS (SELECT *, dense_rank() OVER (PARTITION BY year("time") ORDER BY "time") AS k FROM c WHERE year("time") IN (1996, 1997))
SELECT CAST(a.k AS INT) AS "day", a.j, a.i, round(a.v - b.v, 3) AS v FROM n a JOIN n b ON a.k = b.k AND a.j = b.j AND a.i = b.i WHERE year(a."time") = 1997 AND year(b."time") = 1996""")
def composite_difference(spark, d):
    c = cube(spark, d).groupBy("time", "j", "i").agg(F.avg("v").alias("v"))
    year = lambda y: select.time_slice(c, f"{y}-01-01", f"{y}-12-31")
    return rounded(enso.composite_difference(year(1997), year(1996), "v"), 3, "v")


@query("""SELECT coalesce(a."time", b."time") AS "time", coalesce(a.level, b.level) AS level, a.v, b.w FROM (SELECT "time", level, round(avg(v), 7) AS v FROM cube GROUP BY 1, 2) a
FULL OUTER JOIN (SELECT "time", level + 3 AS level, round(avg(w), 6) AS w FROM cube GROUP BY 1, 2) b ON a."time" = b."time" AND a.level = b.level""")
def merge_variables_outer(spark, d):
    """Levels of the second cube are three higher, so that either has coordinates of its own."""
    mean = lambda df, c: reduce.spatial_mean(df, [c])
    c = cube(spark, d)
    return joins.merge_variables(rounded(mean(c.drop("w"), "v"), 7, "v"), rounded(mean(c.drop("v").withColumn("level", F.col("level") + 3), "w"), 6, "w"))


@query('SELECT c."time", j, i, level, v, n_orders FROM cube c JOIN (SELECT o_orderdate AS t, count(*) AS n_orders FROM orders GROUP BY 1) o ON c."time" = o.t')
def attach_second_variable(spark, d):
    per_day = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("time")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.merge_variables(cube(spark, d).drop("w"), per_day, "inner").select("time", "j", "i", "level", "v", "n_orders")


@query('SELECT CAST(year("time") AS INT) AS year, count(*) AS n FROM (SELECT * FROM cube UNION ALL SELECT * FROM cube) GROUP BY 1')
def concat_time(spark, d):
    """Repetitions stay."""
    c = cube(spark, d)
    return files.combine([c, c]).groupBy(F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query('SELECT "time", v, w FROM cube')
def merge_time_sorted(spark, d):
    c = cube(spark, d)
    return files.combine([select.level(c, k) for k in range(1, 8)], sort=True).select("time", "v", "w")


@query("""SELECT count(*) AS n, round(sum(v), 2) AS v FROM cube WHERE "time" BETWEEN TIMESTAMP '1997-11-01' AND TIMESTAMP '1998-01-31'""")
def hydro_year(spark, d):
    c = cube(spark, d)
    both = files.combine([select.time_slice(c, "1997-01-01", "1997-12-31"), select.time_slice(c, "1998-01-01", "1998-12-31")])
    return select.time_slice(both, "1997-11-01", "1998-01-31").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"))


# units and moisture
_UNITS = {"k": "k", "rate": "mm/h", "pressure": "pa", "ratio": "kg/kg", "geopotential": "m**2/s**2", "wind": "m/s"}


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity - 273.15, 6) AS k, round(l_quantity * 24, 6) AS rate, round(l_quantity * 0.01, 6) AS pressure, round(l_quantity * 1000, 6) AS ratio,
round(l_quantity * (1 / 9.80665), 6) AS geopotential, round(l_quantity * 100, 6) AS wind FROM lineitem""".replace("SELECT", "WITH u AS (SELECT 1) SELECT", 1))
def convert_units(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", *[F.round(units.convert(F.col("l_quantity"), u, "w" if k == "wind" else k), 6).alias(k) for k, u in _UNITS.items()])


@query("WITH u AS (SELECT 1) SELECT l_orderkey, l_linenumber, round((l_discount * 0.1) / (1 + l_discount * 0.1) * 1000, 6) AS sh FROM lineitem")
def specific_humidity(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(thermo.specific_humidity(F.col("l_discount") * 0.1), 6).alias("sh"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, 950 + l_quantity AS p, 285 + l_tax * 100 AS t, 0.005 + l_discount * 0.05 AS q FROM lineitem),
b AS (SELECT *, 6.112 * exp(17.67 * (t - 273.15) / (t - 273.15 + 243.5)) AS es FROM a)
SELECT l_orderkey, l_linenumber, round(q / (0.622 * es / (p - es)), 8) AS rh FROM b""")
def relative_humidity(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (950 + F.col("l_quantity")).alias("p"), (285 + F.col("l_tax") * 100).alias("t"), (0.005 + F.col("l_discount") * 0.05).alias("q"))
    return t.select("l_orderkey", "l_linenumber", F.round(thermo.relative_humidity(F.col("p"), F.col("t"), F.col("q")), 8).alias("rh"))


def _ascent() -> str:
    """The ascent of thermo.cape in steps."""
    rd, cp, g, eps = 287.04, 1004.0, 9.81, 0.622
    es = lambda t: f"(6.112 * exp(17.67 * (({t}) - 273.15) / (({t}) - 273.15 + 243.5)))"
    the = lambda p, t, q, lcl: f"({t}) * power(1000 / {p}, 0.2854 * (1 - 0.28 * ({q}))) * exp((3376 / ({lcl}) - 2.54) * ({q}) * (1 + 0.81 * ({q})))"
    cold = lambda p, t, q: f"least(2840 / (3.5 * ln({t}) - ln({q} * {p} / ({eps} + {q})) - 4.805) + 55, {t})"
    tv = lambda t, q: f"(({t}) * ({eps} + ({q})) / ({eps} * (1 + ({q}))))"
    wet = lambda t: f"ln({the('p', t, f'{eps} * {es(t)} / (p - {es(t)})', t)})"
    return f"""WITH s AS (SELECT p_partkey, 1000.0 - 50 * k AS p, 300.0 + p_size / 25.0 - 4.2 * k AS t, 0.018 * exp(-0.25 * k) AS q FROM part, (SELECT CAST(range AS DOUBLE) AS k FROM range(16))),
a AS (SELECT *, {tv('t', 'q')} AS tv, {the('p', 't', 'q', cold('p', 't', 'q'))} AS the FROM s),
b AS (SELECT *, coalesce({rd} / {g} * (tv + lag(tv) OVER w) / 2 * ln(lag(p) OVER w / p), 0) AS dz FROM a WINDOW w AS (PARTITION BY p_partkey ORDER BY p DESC)),
c AS (SELECT *, sum(dz) OVER (PARTITION BY p_partkey ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS z FROM b),
k AS (SELECT p_partkey, max({{'the': the, 'z': -z, 'p': p}}) AS s FROM c WHERE z <= 3000 GROUP BY 1),
m AS (SELECT p_partkey, any_value(s.p) AS pk, avg(q) AS qk, avg(t * power(1000 / p, {rd / cp!r})) AS th FROM c JOIN k USING (p_partkey) WHERE abs(z - greatest(-s.z, 250)) <= 250 OR z = -s.z GROUP BY 1),
n AS (SELECT *, th * power(pk / 1000, {rd / cp!r}) AS tk FROM m), o AS (SELECT *, {cold('pk', 'tk', 'qk')} AS lcl FROM n),
x AS (SELECT *, {the('pk', 'tk', 'qk', 'lcl')} AS th_e, pk * power(lcl / tk, {cp / rd!r}) AS plcl FROM o),
y AS (SELECT c.p_partkey, p, tv, dz, pk, tk, qk, plcl, ln(th_e) AS goal, least(th_e * power(p / 1000, 0.2854), 320) AS t0 FROM c JOIN x USING (p_partkey) WHERE p <= pk),
r AS (SELECT *, list_reduce(list_concat([t0], [CAST(1 AS DOUBLE) FOR _ IN range(10)]), lambda t, _k: t - ({wet('t')} - goal) * 0.01 / ({wet('t + 0.01')} - {wet('t')})) AS tw FROM y),
f AS (SELECT *, CASE WHEN p >= plcl THEN tk * power(p / pk, {rd / cp!r}) ELSE tw END AS tp FROM r),
h AS (SELECT *, {g} * ({tv('tp', f'CASE WHEN p >= plcl THEN qk ELSE least({eps} * {es("tp")} / (p - {es("tp")}), qk) END')} / tv - 1) AS b FROM f),
i AS (SELECT *, lag(b) OVER (PARTITION BY p_partkey ORDER BY p DESC) AS a FROM h),
j AS (SELECT *, CASE WHEN a IS NULL THEN 0 WHEN (a > 0) <> (b > 0) THEN greatest(a, b) ** 2 / (2 * abs(a - b)) ELSE greatest((a + b) / 2, 0) END * dz AS plus,
  CASE WHEN a IS NULL THEN 0 WHEN (a > 0) <> (b > 0) THEN -(least(a, b) ** 2) / (2 * abs(a - b)) ELSE least((a + b) / 2, 0) END * dz AS minus FROM i),
l AS (SELECT *, coalesce(sum(plus) OVER (PARTITION BY p_partkey ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
SELECT p_partkey, round(sum(plus), 4) AS cape, round(CASE WHEN sum(plus) > 0 THEN sum(CASE WHEN before = 0 AND NOT coalesce(a > 0, false) THEN minus ELSE 0 END) ELSE 0 END, 4) AS cin FROM l GROUP BY 1"""


@query(_ascent())
def parcel_cape(spark, d):
    """Profiles over part sizes: temperature and moisture fall with pressure."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")
    p = table(spark, d, "part").select("p_partkey", "p_size", levels)
    at = p.select("p_partkey", (1000.0 - 50 * F.col("k")).alias("p"), (300.0 + F.col("p_size") / 25.0 - 4.2 * F.col("k")).alias("t"), (0.018 * F.exp(-0.25 * F.col("k"))).alias("q"))
    return rounded(thermo.cape(at, ["p_partkey"]), 4, "cape", "cin")


# index of warm and cold years
_ROLL = """, r AS (SELECT "time", CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS value FROM idx WINDOW w AS (ORDER BY "time" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
yc AS (SELECT year("time") AS year, CASE WHEN max(value) >= 0.3 THEN 1 WHEN min(value) <= -0.3 THEN -1 ELSE 0 END AS class FROM r GROUP BY 1)
"""


@query(_ROLL + "SELECT CAST(year AS INT) AS year, CAST(class AS INT) AS class FROM yc")
def enso_class_full_year(spark, d):
    return enso.classify_years(index(spark, d), 0.3).select("year", "class")


@query("""SELECT CAST(quarter("time") AS INT) AS season, CAST(year("time") AS INT) AS year, CAST(CASE WHEN max(value) >= 0.3 THEN 1 WHEN min(value) <= -0.3 THEN -1 ELSE 0 END AS INT) AS class FROM idx GROUP BY 1, 2""")
def enso_class_by_season(spark, d):
    return enso.classify_seasons(index(spark, d), 0.3)


_YEARS = _ROLL + """, y AS (SELECT year("time") AS year, avg(v) AS v FROM (SELECT "time", avg(v) AS v FROM cube GROUP BY 1) GROUP BY 1), c AS (SELECT y.year, v, class FROM y LEFT JOIN yc ON y.year = yc.year)
"""


def _classed(spark, d) -> DataFrame:
    yearly = reduce.yearly_mean(reduce.spatial_mean(cube(spark, d).drop("level"), ["v"]), ["v"])
    return yearly.join(enso.classify_years(index(spark, d), 0.3).select("year", "class"), "year", "left")


@query(_YEARS + """SELECT round(avg(v), 3) AS mean, round(avg(CASE WHEN class = 1 THEN v END), 3) AS mean_nino, round(avg(CASE WHEN class = -1 THEN v END), 3) AS mean_nina, round(avg(CASE WHEN class <> 1 THEN v END), 3) AS mean_no_nino, round(avg(CASE WHEN class <> -1 THEN v END), 3) AS mean_no_nina,
round(avg(CASE WHEN class = 1 THEN v END) - avg(v), 3) AS anomaly_nino, round(avg(CASE WHEN class = -1 THEN v END) - avg(v), 3) AS anomaly_nina, round(avg(CASE WHEN class <> 1 THEN v END) - avg(v), 3) AS anomaly_no_nino, round(avg(CASE WHEN class <> -1 THEN v END) - avg(v), 3) AS anomaly_no_nina FROM c""")
def enso_anomalies(spark, d):
    out = reduce.subset_anomalies(_classed(spark, d), "v", enso.masks(F.col("class")))
    return rounded(out, 3, *out.columns)


@query(_YEARS + f"SELECT {_FIT.replace('y, x', 'CASE WHEN class <> 1 THEN v END, year')} FROM c")
def no_nino_trend(spark, d):
    own = _classed(spark, d).withColumn("y", F.when(F.col("class") != 1, F.col("v")))
    return _fit(regression.ols(own, "y", "year"))


# trend maps
_CELLS = """, cy AS (SELECT j, i, year("time") AS year, avg(v) AS v FROM cube GROUP BY 1, 2, 3),
f AS (SELECT j, i, count(*) AS na, regr_count(v, year) AS n, regr_slope(v, year) AS s, regr_sxx(v, year) AS xx, regr_syy(v, year) AS yy, regr_sxy(v, year) AS xy FROM cy GROUP BY 1, 2),
t AS (SELECT j, i, n, s, CASE WHEN n > 2 AND yy - s * xy > 1e-12 * yy THEN s * sqrt((n - 2) * xx / (yy - s * xy)) END AS t FROM f WHERE n > 0)
"""


def _trend(spark, d) -> DataFrame:
    return regression.trend_map(reduce.yearly_mean(cube(spark, d), ["v"], ["j", "i"]), "v")


@query(_CELLS + "SELECT j, i, n, round(s, 7) AS slope, round(t, 6) AS t FROM t")
def trend_map(spark, d):
    return rounded(rounded(_trend(spark, d), 7, "slope"), 6, "t")


# p-values of Student's t for 1 to 5 degrees of freedom; the tables have seven years
_P = """, a AS (SELECT *, n - 2 AS df, atan(abs(t) / sqrt(n - 2)) AS h FROM t WHERE n > 2),
p AS (SELECT j, i, n, s, t, 1 - CASE df WHEN 1 THEN 2 / pi() * h WHEN 2 THEN sin(h) WHEN 3 THEN 2 / pi() * (h + sin(h) * cos(h)) WHEN 4 THEN sin(h) * (1 + cos(h) ** 2 / 2)
      WHEN 5 THEN 2 / pi() * (h + sin(h) * (cos(h) + 2.0 / 3 * cos(h) ** 3)) END AS p FROM a UNION ALL SELECT j, i, n, s, t, NULL FROM t WHERE n <= 2)
"""


@query(_CELLS + _P + "SELECT j, i, round(s, 7) AS slope FROM p WHERE p < 0.05")
def trend_map_significant(spark, d):
    return rounded(regression.significant(_trend(spark, d)).select("j", "i", "slope"), 7, "slope")


@query(_CELLS + "SELECT round(greatest(abs(min(s)), max(s)), 5) AS \"limit\" FROM t")
def trend_symmetric_range(spark, d):
    return rounded(reduce.symmetric_range(_trend(spark, d), "slope"), 5, "limit")


@query(_CELLS + _P + """, r AS (SELECT *, rank() OVER (ORDER BY p) AS r, count(p) OVER () AS m FROM p WHERE p IS NOT NULL),
q AS (SELECT j, i, least(min(p * m / r) OVER (ORDER BY r DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS q FROM r)
SELECT p.j, p.i, round(p, 7) AS p, round(q, 7) AS p_adjusted FROM p LEFT JOIN q ON p.j = q.j AND p.i = q.i""")
def trend_map_adjusted(spark, d):
    """p-values and their Benjamini-Hochberg adjustment."""
    return rounded(regression.adjusted(regression.with_p(_trend(spark, d))).select("j", "i", "p", "p_adjusted"), 7, "p", "p_adjusted")


# one series
_Y = """, y AS (SELECT CAST(year("time") AS INT) AS year, avg(v) AS v FROM (SELECT "time", avg(v) AS v FROM cube GROUP BY 1) GROUP BY 1)
"""
_ONE = "(SELECT regr_slope(v, year) AS s, regr_intercept(v, year) AS c, regr_count(v, year) AS n, regr_avgx(v, year) AS m, regr_sxx(v, year) AS xx, regr_syy(v, year) AS yy, regr_sxy(v, year) AS xy FROM y)"


def _yearly(spark, d) -> DataFrame:
    return reduce.yearly_mean(reduce.spatial_mean(cube(spark, d).drop("level"), ["v"]), ["v"])


@query(_Y + f"SELECT year, round(v, 3) AS v, round(c + s * year, 3) AS fitted, round(c + s * year - 2.570581836 * sqrt((yy - s * xy) / (n - 2)) * sqrt(1.0 / n + (year - m) * (year - m) / xx), 3) AS low, round(c + s * year + 2.570581836 * sqrt((yy - s * xy) / (n - 2)) * sqrt(1.0 / n + (year - m) * (year - m) / xx), 3) AS high FROM y, {_ONE}")
def prediction_band(spark, d):
    return rounded(regression.prediction_band(_yearly(spark, d), "v", "year"), 3, "v", "fitted", "low", "high")


@query(_Y + f"SELECT CAST(k AS INT) AS k, round(1995 + k * (6.0 / 99), 6) AS x, round(c + s * (1995 + k * (6.0 / 99)), 3) AS y FROM {_ONE}, (SELECT range AS k FROM range(100))")
def trend_line_points(spark, d):
    line = regression.trend_line(regression.ols(_yearly(spark, d), "v", "year"), 1995, 2001)
    return line.select("k", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"))


@query(_Y + f"SELECT year, round(v - (c + s * year), 3) AS residual FROM y, {_ONE}")
def residuals(spark, d):
    return regression.residuals(_yearly(spark, d), "v", "year").select("year", F.round("residual", 3).alias("residual"))


@query(_Y + f", e AS (SELECT year, v - (c + s * year) AS e FROM y, {_ONE}), z AS (SELECT year, e - avg(e) OVER () AS e FROM e), l AS (SELECT e, lag(e) OVER (ORDER BY year) AS b FROM z) SELECT round(sum(e * b) / sum(e * e), 6) AS acf1 FROM l")
def residual_lag1_acf(spark, d):
    e = regression.residuals(_yearly(spark, d), "v", "year")
    return rounded(series.lag1_autocorrelation(e, "residual", "year"), 6, "acf1")


def _cell_years(spark, d) -> DataFrame:
    return reduce.yearly_mean(cube(spark, d), ["v"], ["j", "i"])


def _rounded_fit(fit: DataFrame) -> DataFrame:
    return fit.select("j", "i", "n", F.round("slope", 2).alias("slope"), F.round("intercept", 0).alias("intercept"), F.round("t", 3).alias("t"))


# a series per cell: years counted from 1998, what a plain line leaves, weights of pairs of years, and the weighted line
_SERIES = """, y AS (SELECT j, i, CAST(year("time") AS INT) - 1998 AS x, avg(v) AS v FROM cube GROUP BY 1, 2, 3),
o AS (SELECT j, i, count(*) AS n, regr_slope(v, x) AS s, regr_intercept(v, x) AS c FROM y GROUP BY 1, 2),
e AS (SELECT j, i, x, v, n, v - c - s * x AS e FROM y JOIN o USING (j, i)),
"""
_FACTOR = "rho AS (SELECT j, i, sum(e * b) / sum(e * e) AS r FROM (SELECT j, i, e, lag(e) OVER (PARTITION BY j, i ORDER BY x) AS b FROM e) GROUP BY 1, 2), "
_ENDS = "f AS (SELECT *, row_number() OVER (PARTITION BY j, i ORDER BY x) AS k FROM e), "
_BOTH = "w AS (SELECT p.j, p.i, p.n, p.x AS x1, p.v AS v1, q.x AS x2, q.v AS v2, {} AS k FROM f p JOIN f q ON p.j = q.j AND p.i = q.i JOIN rho ON rho.j = p.j AND rho.i = p.i), "
_LINE = """g AS (SELECT j, i, any_value(n) AS n, sum(k) AS aa, sum(k * x2) AS ax, sum(k * x1 * x2) AS xx, sum(k * v2) AS ay, sum(k * x1 * v2) AS xy FROM w GROUP BY 1, 2),
b AS (SELECT j, i, n, (aa * xy - ax * ay) / (aa * xx - ax * ax) AS s, (xx * ay - ax * xy) / (aa * xx - ax * ax) AS c, aa / (aa * xx - ax * ax) AS q FROM g),
z AS (SELECT j, i, sum(k * (v1 - c - s * x1) * (v2 - c - s * x2)) AS rss FROM w JOIN b USING (j, i) GROUP BY 1, 2)
SELECT j, i, n, round(s, 2) AS slope, round(c - 1998 * s, 0) AS intercept, round(s / sqrt(q * rss / (n - 2)), 3) AS t FROM b JOIN z USING (j, i)"""
# the inverse of r ** |difference of places|, but for a factor
_PRECISION = "CASE WHEN p.k = q.k THEN CASE WHEN p.k IN (1, p.n) THEN 1 ELSE 1 + r * r END WHEN abs(p.k - q.k) = 1 THEN -r ELSE 0 END"
_VARIANCE = """h AS (SELECT j, i, regr_slope(e * e, x) AS s, regr_intercept(e * e, x) AS c FROM e GROUP BY 1, 2),
u AS (SELECT j, i, n, x, v, h.c + h.s * x AS u, max(h.c + h.s * x) OVER (PARTITION BY j, i) AS m FROM e JOIN h USING (j, i)),
w AS (SELECT j, i, n, x AS x1, v AS v1, x AS x2, v AS v2, 1 / greatest(u, 1e-6 * m) AS k FROM u), """


@query(_SERIES + _FACTOR + _ENDS + _BOTH.format(_PRECISION) + _LINE)
def fit_gls_ar1(spark, d):
    return _rounded_fit(regression.fit(_cell_years(spark, d), "v", "year", ["j", "i"], "gls-ar1"))


@query(_SERIES + _FACTOR + _ENDS + _BOTH.format("r ** abs(p.k - q.k)") + _LINE)
def fit_gls_ar1_inverted(spark, d):
    return _rounded_fit(regression.fit(_cell_years(spark, d), "v", "year", ["j", "i"], "gls-ar1", "inverted"))


@query(_SERIES + _VARIANCE + _LINE)
def fit_gls_hs(spark, d):
    return _rounded_fit(regression.fit(_cell_years(spark, d), "v", "year", ["j", "i"], "gls-hs"))


def _huber(steps: int) -> str:
    """Steps of reweighting, a table each: weights, and the line under them."""
    out = "l0 AS (SELECT j, i, s, c FROM o), "
    for k in range(steps):
        out += f"""m{k} AS (SELECT j, i, quantile_cont(abs(v - c - s * x), 0.5) / 0.6744897501960817 AS scale FROM y JOIN l{k} USING (j, i) GROUP BY 1, 2),
w{k} AS (SELECT j, i, n, x AS x1, v AS v1, x AS x2, v AS v2, least(1, 1.345 / greatest(abs(e.v - l.c - l.s * x) / scale, 1e-12)) AS k FROM e JOIN l{k} AS l USING (j, i) JOIN m{k} USING (j, i)),
l{k + 1} AS (SELECT j, i, (sum(k) * sum(k * x1 * v1) - sum(k * x1) * sum(k * v1)) / (sum(k) * sum(k * x1 * x1) - sum(k * x1) ** 2) AS s, (sum(k * x1 * x1) * sum(k * v1) - sum(k * x1) * sum(k * x1 * v1)) / (sum(k) * sum(k * x1 * x1) - sum(k * x1) ** 2) AS c FROM w{k} GROUP BY 1, 2),
"""
    return out + f"w AS (SELECT * FROM w{steps - 1}), "


@query(_SERIES + _huber(3) + _LINE)
def fit_rls(spark, d):
    """Three steps of reweighting, which SQL can follow; fit(model="rls") goes on until lines stay."""
    return _rounded_fit(regression.robust(_cell_years(spark, d), "v", "year", ["j", "i"], 3))


@query(_SERIES.replace("avg(v) AS v", "ln(avg(v)) AS v") + """t AS (SELECT * FROM (VALUES (1, CAST(12.706204736174694 AS DOUBLE)), (2, CAST(4.302652729749464 AS DOUBLE)), (3, CAST(3.18244630528371 AS DOUBLE)), (4, CAST(2.7764451051977943 AS DOUBLE)), (5, CAST(2.5705818356363146 AS DOUBLE))) AS q(df, t)),
m AS (SELECT j, i, avg(x) AS mx, sum(e * e) AS rss, regr_sxx(v, x) AS xx FROM e GROUP BY 1, 2)
SELECT j, i, x + 1998 AS year, round(v - e, 5) AS fitted, round(v - e - t * sqrt(rss / (n - 2)) * sqrt(1.0 / n + (x - mx) ** 2 / xx), 5) AS low, round(v - e + t * sqrt(rss / (n - 2)) * sqrt(1.0 / n + (x - mx) ** 2 / xx), 5) AS high
FROM e JOIN m USING (j, i) JOIN t ON t.df = n - 2""")
def prediction_band_map(spark, d):
    """Bands of the logarithms of every cell, each by the quantile for its own number of years."""
    years = _cell_years(spark, d).withColumn("v", F.log("v"))
    band = regression.prediction_band(years, "v", "year", by=["j", "i"]).where("low IS NOT NULL")
    return rounded(band.select("j", "i", "year", "fitted", "low", "high"), 5, "fitted", "low", "high")


# observations
_DAYS = """, b AS (SELECT user_id AS station, event_type AS sensor, CAST(ts AS DATE) AS day, sum(value) AS s, avg(value) AS m FROM events GROUP BY 1, 2, 3),
span AS (SELECT station, sensor, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b GROUP BY 1, 2)
"""


def _gappy(spark, d) -> DataFrame:
    """A station per user: few have values on all days."""
    return table(spark, d, "events").select(F.col("user_id").alias("station"), "ts", F.col("event_type").alias("sensor"), "value")


@query(_DAYS + "SELECT station, sensor, day, round(coalesce(s, 0), 4) AS value FROM span LEFT JOIN b USING (station, sensor, day)")
def daily_sum_gapfilled(spark, d):
    return rounded(series.daily(_gappy(spark, d), "value", ["station", "sensor"]), 4, "value")


@query(_DAYS + "SELECT station, sensor, day, round(m, 6) AS value FROM span LEFT JOIN b USING (station, sensor, day)")
def daily_mean_gaps_null(spark, d):
    return rounded(series.daily(_gappy(spark, d), "value", ["station", "sensor"], "mean"), 6, "value")


@query(_DAYS + "SELECT station, sensor, day, round(sum(coalesce(s, 0)) OVER (PARTITION BY station, sensor ORDER BY day ROWS UNBOUNDED PRECEDING), 3) AS cumulative FROM span LEFT JOIN b USING (station, sensor, day)")
def cumulative_daily(spark, d):
    c = series.cumulative(series.daily(_gappy(spark, d), "value", ["station", "sensor"]), "value", ["station", "sensor"])
    return c.select("station", "sensor", "day", F.round("cumulative", 3).alias("cumulative"))


@query("SELECT CAST(unnest(generate_series(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP), CAST(CAST(max(ts) AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM obs")
def calendar_days(spark, d):
    return series.calendar_of(observations(spark, d), "ts")


_PAIR = """, a AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS observed FROM obs GROUP BY 1),
m AS (SELECT CAST("time" + INTERVAL 10440 DAY AS DATE) AS day, round(avg(v), 6) AS model FROM cube GROUP BY 1)
"""


def _pair(spark, d, how: str) -> DataFrame:
    o = observations(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("observed"))
    m = cube(spark, d).groupBy(F.date_add(F.to_date("time"), 10440).alias("day")).agg(F.round(F.avg("v"), 6).alias("model"))
    return joins.with_model(o, m, how, ["day"])


@query(_PAIR + "SELECT day, observed, model FROM a JOIN m USING (day)")
def obs_model_join_inner(spark, d):
    return _pair(spark, d, "inner")


@query(_PAIR + "SELECT day, observed, model FROM a FULL OUTER JOIN m USING (day)")
def obs_model_join_outer(spark, d):
    return _pair(spark, d, "full_outer")


@query("SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"round(sum(CASE WHEN station = {k} THEN value END), 4) AS s{k}" for k in range(12)) + " FROM obs GROUP BY 1")
def station_wide_pivot(spark, d):
    o = observations(spark, d).select(F.to_date("ts").alias("day"), F.concat(F.lit("s"), F.col("station")).alias("station"), "value").groupBy("day", "station").agg(F.round(F.sum("value"), 4).alias("value"))
    return files.long_to_wide(o, [f"s{k}" for k in range(12)], time="day")


@query("""SELECT make_date(CAST(year("time") AS INT), CAST(month("time") AS INT), 1) AS "time", round(value, 9) AS value FROM idx""")
def index_melt(spark, d):
    wide = index(spark, d).withColumn("m", F.date_format("time", "MM")).groupBy(F.year("time").alias("year")).pivot("m", [f"{k:02d}" for k in range(1, 13)]).agg(F.first("value"))
    return rounded(enso.long_index(wide).where("value IS NOT NULL"), 9, "value")


@query("SELECT event_id, ts + INTERVAL 6 HOUR AS utc FROM events")
def local_to_utc(spark, d):
    return table(spark, d, "events").select("event_id", calendar.local_to_utc(F.col("ts")).alias("utc"))


# stations and grids
_POINTS = "sites"
_STATIONS = "(VALUES " + ", ".join(f"('{n}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for n, a, b in joins.STATIONS) + ") AS st(station, slat, slon)"


@query(f"""SELECT station, j, i, round(dist, 9) AS dist FROM (SELECT station, j, i, greatest(abs(lat - slat), abs(lon - slon)) AS dist,
row_number() OVER (PARTITION BY k ORDER BY greatest(abs(lat - slat), abs(lon - slon)), j, i) AS r FROM field, {_POINTS}) WHERE r = 1""")
def nearest_gridpoint(spark, d):
    return rounded(joins.nearest_cell(sites(spark, d), field(spark, d)), 9, "dist")


@query(f""", n AS (SELECT station, j, i FROM (SELECT station, j, i, row_number() OVER (PARTITION BY station ORDER BY greatest(abs(lat - slat), abs(lon - slon)), j, i) AS r FROM grid, {_STATIONS}) WHERE r = 1)
SELECT station, CAST(year("time") AS INT) AS year, round(avg(v), 4) AS v FROM cube c JOIN n ON c.j = n.j AND c.i = n.i GROUP BY 1, 2""")
def nearest_gridpoint_series(spark, d):
    s = joins.nearest_series(cube(spark, d), joins.stations(spark), grid(spark), "v")
    return s.groupBy("station", F.year("time").alias("year")).agg(F.round(F.avg("v"), 4).alias("v"))


_BILINEAR = """SELECT {keys}, round((1 - fx) * (1 - fy) * a.hgt + fx * (1 - fy) * b.hgt + (1 - fx) * fy * c.hgt + fx * fy * e.hgt, 5) AS hgt FROM (
SELECT *, x - floor(x) AS fx, y - floor(y) AS fy, CAST(floor(x) AS INT) AS pi, CAST(floor(y) AS INT) AS pj FROM ({points})) p
LEFT JOIN field a ON a.j = pj AND a.i = pi LEFT JOIN field b ON b.j = pj AND b.i = pi + 1 LEFT JOIN field c ON c.j = pj + 1 AND c.i = pi LEFT JOIN field e ON e.j = pj + 1 AND e.i = pi + 1"""


@query(_BILINEAR.format(keys="station", points=f"SELECT station, (slon + 91.5) / 0.05 AS x, (slat + 1.5) / 0.05 AS y FROM {_POINTS}"))
def bilinear_to_stations(spark, d):
    b = regrid.bilinear(sites(spark, d).select("station", "lon", "lat"), field(spark, d), "hgt", (-91.5, -1.5), (0.05, 0.05))
    return b.select("station", F.round("hgt", 5).alias("hgt"))


@query(_BILINEAR.format(keys="tj, ti", points="SELECT tj, ti, (-91.493 + ti * 0.0154 + 91.5) / 0.05 AS x, (-1.487 + tj * 0.0154 + 1.5) / 0.05 AS y FROM (SELECT CAST(range AS INT) AS tj FROM range(25)), (SELECT CAST(range AS INT) AS ti FROM range(60))"))
def regrid_bilinear(spark, d):
    target = regrid.lonlat_grid(spark, 60, 25, -91.493, 0.0154, -1.487, 0.0154).select(F.col("j").alias("tj"), F.col("i").alias("ti"), "lon", "lat")
    return regrid.bilinear(target, field(spark, d), "hgt", (-91.5, -1.5), (0.05, 0.05)).select("tj", "ti", F.round("hgt", 5).alias("hgt"))


_W = "CASE WHEN {0} <= 1 THEN 1.5 * {0} ** 3 - 2.5 * {0} ** 2 + 1 WHEN {0} < 2 THEN -0.5 * {0} ** 3 + 2.5 * {0} ** 2 - 4 * {0} + 2 ELSE 0 END"


@query(f""", p AS (SELECT tj, ti, (-91.493 + ti * 0.0154 + 91.5) / 0.05 AS x, (-1.487 + tj * 0.0154 + 1.5) / 0.05 AS y FROM (SELECT CAST(range AS INT) AS tj FROM range(25)), (SELECT CAST(range AS INT) AS ti FROM range(60))),
k AS (SELECT tj, ti, x, y, CAST(floor(x) AS INT) + di AS i, CAST(floor(y) AS INT) + dj AS j FROM p, (SELECT unnest([-1, 0, 1, 2]) AS di), (SELECT unnest([-1, 0, 1, 2]) AS dj))
SELECT tj, ti, round(CASE WHEN count(hgt) = 16 THEN sum(({_W.format('abs(x - k.i)')}) * ({_W.format('abs(y - k.j)')}) * hgt) END, 5) AS hgt FROM k LEFT JOIN field g ON k.i = g.i AND k.j = g.j GROUP BY 1, 2""")
def regrid_bicubic(spark, d):
    target = regrid.lonlat_grid(spark, 60, 25, -91.493, 0.0154, -1.487, 0.0154).select(F.col("j").alias("tj"), F.col("i").alias("ti"), "lon", "lat")
    return regrid.bicubic(target, field(spark, d), "hgt", (-91.5, -1.5), (0.05, 0.05)).select("tj", "ti", F.round("hgt", 5).alias("hgt"))


_TARGET = "SELECT CAST(range // 30 AS INT) AS tj, CAST(range % 30 AS INT) AS ti, -91.4931 + (range % 30) * 0.0313 AS lon, -1.4873 + (range // 30) * 0.0283 AS lat FROM range(450)"


def _target(spark) -> DataFrame:
    return regrid.lonlat_grid(spark, 30, 15, -91.4931, 0.0313, -1.4873, 0.0283).select(F.col("j").alias("tj"), F.col("i").alias("ti"), "lon", "lat")


@query(f""", q AS (SELECT *, floor(x) AS fi, floor(y) AS fj FROM (SELECT tj, ti, (lon + 91.5) / 0.05 AS x, (lat + 1.5) / 0.05 AS y FROM ({_TARGET}))),
k AS (SELECT tj, ti, CAST(fi AS INT) + di AS i, CAST(fj AS INT) + dj AS j, CASE di WHEN 1 THEN x - fi ELSE 1 - x + fi END * CASE dj WHEN 1 THEN y - fj ELSE 1 - y + fj END AS k FROM q, (SELECT unnest([0, 1]) AS di), (SELECT unnest([0, 1]) AS dj)),
c AS (SELECT j, i, CAST(year("time") AS INT) AS "time", avg(v) AS v FROM cube GROUP BY 1, 2, 3), moments AS (SELECT DISTINCT "time" FROM c)
SELECT m."time", tj, ti, round(CASE WHEN count(v) = count(*) THEN sum(k * v) END, 3) AS v FROM k CROSS JOIN moments m LEFT JOIN c ON k.i = c.i AND k.j = c.j AND c."time" = m."time" WHERE k <> 0 GROUP BY 1, 2, 3""")
def remap_all_times(spark, d):
    yearly = reduce.yearly_mean(cube(spark, d), ["v"], ["j", "i"]).withColumnRenamed("year", "time")
    weights = regrid.bilinear_weights(_target(spark), (-91.5, -1.5), (0.05, 0.05))
    return rounded(regrid.remap(yearly, weights, "v"), 3, "v")


@query(f"SELECT tj, ti, hgt FROM ({_TARGET}) t LEFT JOIN field g ON g.i = floor((t.lon + 91.5) / 0.05 + 0.5) AND g.j = floor((t.lat + 1.5) / 0.05 + 0.5)")
def transform_nearest(spark, d):
    return regrid.transform_nearest(_target(spark), field(spark, d).select("j", "i", "hgt"), "hgt", (-91.5, -1.5), (0.05, 0.05)).select("tj", "ti", "hgt")


@query(f"SELECT station, round((slon + 91.5) / 0.05, 6) AS x, round((slat + 1.5) / 0.05, 6) AS y FROM {_POINTS}")
def station_pixels(spark, d):
    x, y = regrid.pixels(F.col("lon"), F.col("lat"), (-91.5, -1.5), (0.05, 0.05))
    return sites(spark, d).select("station", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""SELECT CAST(g.j AS INT) AS j, CAST(g.i AS INT) AS i, round(CAST(-92.5061 AS DOUBLE) + g.i * CAST(0.0154 AS DOUBLE), 6) AS lon, round(CAST(-2.46528 AS DOUBLE) + g.j * CAST(0.0154 AS DOUBLE), 6) AS lat, coalesce(n, 0) AS n
FROM (SELECT a.range AS j, b.range AS i FROM range(230) a, range(245) b) g
LEFT JOIN (SELECT floor((lat + 2.46528) / 0.0154 + 0.5) AS j, floor((lon + 92.5061) / 0.0154 + 0.5) AS i, count(*) AS n FROM places GROUP BY 1, 2) p ON p.j = g.j AND p.i = g.i""")
def lonlat_grid(spark, d):
    """The cells of a grid, and how many places each has."""
    x, y = regrid.pixels(F.col("lon"), F.col("lat"), (-92.5061, -2.46528), (0.0154, 0.0154))
    per_cell = places(spark, d).groupBy(F.floor(y + 0.5).cast("int").alias("j"), F.floor(x + 0.5).cast("int").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    cells = regrid.lonlat_grid(spark, 245, 230, -92.5061, 0.0154, -2.46528, 0.0154).join(per_cell, ["j", "i"], "left")
    return rounded(cells, 6, "lon", "lat").withColumn("n", F.coalesce("n", F.lit(0)))


_NAMELIST = """
 parent_id         = 1, 1, 2,
 parent_grid_ratio = 1, 5, 10,
 i_parent_start    = 1, 67, 103,
 j_parent_start    = 1, 78, 85,
 e_we = 300, 246, 400,
 e_sn = 210, 231, 350,
 dx = 10000,
 dy = 10000,
 map_proj = 'mercator',
 ref_lat = 0,
 ref_lon = -85,
 truelat1 = 0,
 stand_lon = -85,
"""
_NEST = CTE.replace("WITH", "WITH RECURSIVE", 1) + """, p(k, parent, ratio, i0, j0, we, sn) AS (VALUES (1, 1, 1, 1, 1, 300, 210), (2, 1, 5, 67, 78, 246, 231), (3, 2, 10, 103, 85, 400, 350)),
d(k, x, y, dx, x1, y1) AS (
  SELECT k, -(we - 1) * CAST(10000 AS DOUBLE) / 2, -(sn - 1) * CAST(10000 AS DOUBLE) / 2, CAST(10000 AS DOUBLE), (we - 1) * CAST(10000 AS DOUBLE) / 2, (sn - 1) * CAST(10000 AS DOUBLE) / 2 FROM p WHERE k = 1
  UNION ALL SELECT p.k, d.x + (i0 - 1) * d.dx, d.y + (j0 - 1) * d.dx, d.dx / ratio, d.x + (i0 - 1) * d.dx + (we - 1) * d.dx / ratio, d.y + (j0 - 1) * d.dx + (sn - 1) * d.dx / ratio FROM p JOIN d ON p.parent = d.k AND p.k > d.k),
ll AS (SELECT 'd0' || d.k AS id, dx, x / 6370000 * 180 / pi() - 85 AS lon_min, x1 / 6370000 * 180 / pi() - 85 AS lon_max, (2 * atan(exp(y / 6370000)) - pi() / 2) * 180 / pi() AS lat_min, (2 * atan(exp(y1 / 6370000)) - pi() / 2) * 180 / pi() AS lat_max FROM d)
"""


def _domains(spark) -> DataFrame:
    return domains.domains(spark, domains.parse_namelist(_NAMELIST))


@query(_NEST + "SELECT id, dx, round(lon_min, 6) AS lon_min, round(lon_max, 6) AS lon_max, round(lat_min, 6) AS lat_min, round(lat_max, 6) AS lat_max, (SELECT count(*) FROM places p WHERE p.lon BETWEEN lon_min AND lon_max AND p.lat BETWEEN lat_min AND lat_max) AS n FROM ll")
def domain_corners(spark, d):
    """Corners of domains, and how many places each has."""
    boxes = _domains(spark).select("id", "dx", "lon_min", "lon_max", "lat_min", "lat_max")
    n = joins.features_in_boxes(places(spark, d), boxes).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(boxes.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))), 6, "lon_min", "lon_max", "lat_min", "lat_max")


@query("SELECT round(min(radians(slon) * 6378137), 2) AS x_min, round(min(ln(tan(pi() / 4 + radians(slat) / 2)) * 6378137), 2) AS y_min, round(max(radians(slon + 0.25) * 6378137), 2) AS x_max, round(max(ln(tan(pi() / 4 + radians(slat + 0.5) / 2)) * 6378137), 2) AS y_max FROM sites")
def web_mercator_bounds(spark, d):
    """The extent of boxes at all sites."""
    boxes = sites(spark, d).select(F.col("lon").alias("lon_min"), (F.col("lon") + 0.25).alias("lon_max"), F.col("lat").alias("lat_min"), (F.col("lat") + 0.5).alias("lat_max"))
    return rounded(domains.total_bounds(boxes), 2, "x_min", "y_min", "x_max", "y_max")


@query(_NEST + "SELECT p.k, id FROM ll, places p WHERE p.lon BETWEEN lon_min AND lon_max AND p.lat BETWEEN lat_min AND lat_max")
def domain_feature_bbox_join(spark, d):
    return joins.features_in_boxes(places(spark, d), _domains(spark).select("id", "lon_min", "lon_max", "lat_min", "lat_max")).select("k", "id")


_RINGS = {"a": [(-91.2, -1.4), (-90.7, -1.4), (-90.7, -1.1), (-90.95, -1.25), (-91.2, -1.1)], "b": [(-91.05, -1.2), (-90.85, -1.06), (-90.6, -1.3)]}
_EDGES = ", edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for k, r in _RINGS.items() for a, b in zip(r, [*r[1:], r[0]], strict=True)) + ") AS v(id, x1, y1, x2, y2))"
_INSIDE = "sum(CASE WHEN (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1"


@query(_EDGES + f" SELECT station FROM {_POINTS}, edges WHERE id = 'a' GROUP BY k, station HAVING {_INSIDE.format(x='any_value(slon)', y='any_value(slat)')}".replace("any_value(slon)", "slon").replace("any_value(slat)", "slat"))
def points_in_polygon(spark, d):
    return joins.points_in_polygon(sites(spark, d), _RINGS["a"]).select("station")


def _rings(spark) -> DataFrame:
    return spark.createDataFrame([(k, r) for k, r in _RINGS.items()], "id string, ring array<struct<x: double, y: double>>")


@query(_EDGES + f""", seg AS (SELECT a.k, a.slon AS ax, a.slat AS ay, b.slon AS bx, b.slat AS by_ FROM sites a JOIN sites b ON b.k = a.k + 1),
hit AS (SELECT k, id FROM seg, edges WHERE least(ax, bx) <= greatest(x1, x2) AND greatest(ax, bx) >= least(x1, x2) AND least(ay, by_) <= greatest(y1, y2) AND greatest(ay, by_) >= least(y1, y2)
  AND sign((bx - ax) * (y1 - ay) - (by_ - ay) * (x1 - ax)) * sign((bx - ax) * (y2 - ay) - (by_ - ay) * (x2 - ax)) <= 0 AND sign((x2 - x1) * (ay - y1) - (y2 - y1) * (ax - x1)) * sign((x2 - x1) * (by_ - y1) - (y2 - y1) * (bx - x1)) <= 0),
inside AS (SELECT k, id FROM seg, edges GROUP BY k, id, ax, ay HAVING {_INSIDE.format(x='ax', y='ay')})
SELECT DISTINCT k AS line, id FROM (SELECT * FROM hit UNION ALL SELECT * FROM inside)""")
def lines_in_polygons(spark, d):
    """Lines between sites that follow one another, and the polygons that they meet."""
    point = F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))
    a = sites(spark, d).select("k", point.alias("a"))
    b = sites(spark, d).select((F.col("k") - 1).alias("k"), point.alias("b"))
    lines = a.join(b, "k").select(F.col("k").alias("line"), F.array("a", "b").alias("points"))
    return joins.features_in_polygons(lines, _rings(spark), 0.5).select("line", "id")


_PARTS = {1: [[(-98.0, -8.0), (-80.0, -9.0), (-79.0, 8.0), (-97.0, 7.0)], [(-93.0, -5.0), (-92.0, 5.0), (-83.0, 4.0), (-84.0, -4.5)], [(-90.0, -2.0), (-86.0, -2.0), (-88.0, 2.5)]], 2: [[(-78.0, -3.0), (-74.0, -2.0), (-76.0, 6.0)], [(-90.5, -1.5), (-89.0, 0.5), (-91.5, 0.4)]]}
_SIDES = ", sides AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for k, rings in _PARTS.items() for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)) + ") AS v(id, x1, y1, x2, y2))"


@query(_SIDES + f" SELECT k, id FROM places, sides GROUP BY k, id, lon, lat HAVING {_INSIDE.format(x='lon', y='lat')}")
def places_in_areas(spark, d):
    """Areas with holes, islands in them, and several parts."""
    areas = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in _PARTS.items()], "id int, rings array<array<struct<x: double, y: double>>>")
    return joins.points_in_areas(places(spark, d), areas).select("k", "id")


@query("SELECT station, round(0.25 * (0.5 + k % 7), 6) AS area FROM sites")
def domain_area(spark, d):
    """Of a box at each site, the higher the larger its number's remainder."""
    boxes = sites(spark, d).select("station", F.lit(0.0).alias("lon_min"), F.lit(0.25).alias("lon_max"), F.lit(0.0).alias("lat_min"), (0.5 + F.col("k") % 7).alias("lat_max"))
    return boxes.select("station", F.round(domains.area(), 6).alias("area"))


_DEM = "SELECT k, 1200 * sin(lon / 3) * cos(lat / 3) + 600 * sin(lon * 1.5) * cos(lat * 1.5) + 300 * sin(lon * 4) * cos(lat * 4) + 1500 * exp(-sqrt((lon + 85.0) * (lon + 85.0) + lat * lat) / 2) AS e FROM places"


def _dem(spark, d) -> DataFrame:
    """Synthetic elevation at all places."""
    return regrid.synthetic_elevation(places(spark, d), (-99.0, -71.0), (-10.0, 10.0))


@query(f"{CTE} SELECT k, round(e, 5) AS elevation FROM ({_DEM})")
def synthetic_dem(spark, d):
    return _dem(spark, d).select("k", F.round("elevation", 5).alias("elevation"))


@query(f"{CTE} SELECT count(*) AS n, count(CASE WHEN e > 0 THEN e END) AS n_land, round(sum(CASE WHEN e > 0 THEN e END), 2) AS total FROM ({_DEM})")
def dem_positive_only(spark, d):
    e = masks.positive(F.col("elevation"))
    return _dem(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count(e).alias("n_land"), F.round(F.sum(e), 2).alias("total"))


@query("SELECT j, i, hgt * landmask AS elevation FROM field")
def static_dem(spark, d):
    return regrid.static_elevation(field(spark, d).select("j", "i", "hgt"), field(spark, d).select("j", "i", "landmask"))


@query("SELECT p_partkey, CAST(floor(greatest(least(6 + log2(greatest(360 / greatest(p_size / 10.0, 1e-6), 1)), 14), 1)) AS INT) AS zoom FROM part")
def tile_zoom(spark, d):
    return table(spark, d, "part").select("p_partkey", regrid.zoom(F.col("p_size") / 10).alias("zoom"))


# grids that are not regular in degrees
_TURNED = """, gr AS (SELECT j, i, CAST(-91.3 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (cos(0.3) * i - sin(0.3) * j) AS lon, CAST(-1.6 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (sin(0.3) * i + cos(0.3) * j) + CAST(0.008 AS DOUBLE) * sin(i / 3.0) AS lat FROM field),
qd AS (SELECT a.j, a.i, a.lon AS x00, a.lat AS y00, b.lon - a.lon AS ex, b.lat - a.lat AS ey, c.lon - a.lon AS fx, c.lat - a.lat AS fy, a.lon - b.lon - c.lon + e.lon AS gx, a.lat - b.lat - c.lat + e.lat AS gy
  FROM gr a JOIN gr b ON b.j = a.j AND b.i = a.i + 1 JOIN gr c ON c.j = a.j + 1 AND c.i = a.i JOIN gr e ON e.j = a.j + 1 AND e.i = a.i + 1),
h AS (SELECT t.k, qd.*, t.lon - x00 AS hx, t.lat - y00 AS hy FROM (SELECT k, CAST(-91.5 AS DOUBLE) + CAST(0.0019 AS DOUBLE) * (k * 61 % 997) * 0.5 AS lon, CAST(-1.5 AS DOUBLE) + CAST(0.0016 AS DOUBLE) * (k * 37 % 499) AS lat FROM places) t, qd
  WHERE t.lon - x00 BETWEEN -0.2 AND 0.2 AND t.lat - y00 BETWEEN -0.2 AND 0.2),
r1 AS (SELECT *, gx * fy - gy * fx AS k2, ex * fy - ey * fx + hx * gy - hy * gx AS k1, hx * ey - hy * ex AS k0 FROM h),
r2 AS (SELECT *, -0.5 * (k1 + CASE WHEN k1 < 0 THEN -1 ELSE 1 END * sqrt(greatest(k1 * k1 - 4 * k0 * k2, 0))) AS q FROM r1),
r3 AS (SELECT *, unnest([k0 / nullif(q, 0), q / nullif(k2, 0)]) AS v FROM r2),
r4 AS (SELECT *, CASE WHEN abs(ex + gx * v) > abs(ey + gy * v) THEN (hx - fx * v) / (ex + gx * v) ELSE (hy - fy * v) / (ey + gy * v) END AS u FROM r3 WHERE v BETWEEN -1e-9 AND 1 + 1e-9),
hit AS (SELECT k, min({'j': j, 'i': i, 'u': u, 'v': v}) AS b FROM r4 WHERE u BETWEEN -1e-9 AND 1 + 1e-9 GROUP BY k),
cy AS (SELECT j, i, CAST(year("time") AS INT) AS "time", avg(v) AS v FROM cube GROUP BY 1, 2, 3), moments AS (SELECT DISTINCT "time" FROM cy)
"""


@query(_TURNED + """SELECT m."time", p.k, round((1 - b.u) * (1 - b.v) * a.v + b.u * (1 - b.v) * c.v + (1 - b.u) * b.v * e.v + b.u * b.v * f.v, 2) AS v FROM places p CROSS JOIN moments m LEFT JOIN hit ON hit.k = p.k
LEFT JOIN cy a ON a."time" = m."time" AND a.j = b.j AND a.i = b.i LEFT JOIN cy c ON c."time" = m."time" AND c.j = b.j AND c.i = b.i + 1
LEFT JOIN cy e ON e."time" = m."time" AND e.j = b.j + 1 AND e.i = b.i LEFT JOIN cy f ON f."time" = m."time" AND f.j = b.j + 1 AND f.i = b.i + 1""")
def remap_curvilinear(spark, d):
    """Yearly means on a turned and bent grid, at places in and beside it: NULL beside."""
    j, i = F.col("j"), F.col("i")
    lon, lat = -91.3 + 0.05 * (F.cos(F.lit(0.3)) * i - F.sin(F.lit(0.3)) * j), -1.6 + 0.05 * (F.sin(F.lit(0.3)) * i + F.cos(F.lit(0.3)) * j) + 0.008 * F.sin(i / 3.0)
    turned = field(spark, d).select("j", "i", lon.alias("lon"), lat.alias("lat"))
    k = F.col("k")
    target = places(spark, d).select("k", (-91.5 + 0.0019 * (k * 61 % 997) * 0.5).alias("lon"), (-1.5 + 0.0016 * (k * 37 % 499)).alias("lat"))
    yearly = reduce.yearly_mean(cube(spark, d), ["v"], ["j", "i"]).withColumnRenamed("year", "time")
    return rounded(regrid.remap(yearly, regrid.curvilinear_weights(target, turned, 0.1), "v"), 2, "v")


_LAMBERT = {"map_proj": "LAMBERT", "ref_lat": 0.0, "ref_lon": -85.0, "stand_lon": -85.0, "truelat1": 30.0, "truelat2": 60.0, "parent_id": [1], "parent_grid_ratio": [1], "i_parent_start": [1], "j_parent_start": [1], "e_we": [301], "e_sn": [201], "dx": 30000.0, "dy": 30000.0}
_CONE = """, n AS (SELECT ln(cos(radians(30)) / cos(radians(60))) / ln(tan(pi() / 4 + radians(60) / 2) / tan(pi() / 4 + radians(30) / 2)) AS n),
f AS (SELECT n, 6370000 * cos(radians(30)) * tan(pi() / 4 + radians(30) / 2) ** n / n AS f FROM n)
"""


@query(_CONE + """SELECT k, round((f / tan(pi() / 4 + radians(lat) / 2) ** n * sin(n * radians(lon + 85)) + 150 * 30000) / 30000 - 0.5, 6) AS i, round((f - f / tan(pi() / 4 + radians(lat) / 2) ** n * cos(n * radians(lon + 85)) + 100 * 30000) / 30000 - 0.5, 6) AS j FROM places, f""")
def projected_pixels(spark, d):
    """Pixels of places on a grid in Lambert's projection."""
    i, j = domains.model_pixels(F.col("lon"), F.col("lat"), _LAMBERT)
    return places(spark, d).select("k", F.round(i, 6).alias("i"), F.round(j, 6).alias("j"))


@query(_CONE + """, c AS (SELECT l_orderkey, l_linenumber, (l_partkey % 300 + 0.5 - 150) * 30000 AS x, (l_suppkey % 200 + 0.5 - 100) * 30000 AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, round(degrees(atan2(x, f - y) / n) - 85, 7) AS lon, round(degrees(2 * atan((f / sqrt(x * x + (f - y) * (f - y))) ** (1 / n)) - pi() / 2), 7) AS lat FROM c, f""")
def projected_lonlat(spark, d):
    """Longitude and latitude of the pixel that each row of the cube has on a projected grid."""
    lon, lat = domains.model_lonlat(F.col("l_partkey") % 300, F.col("l_suppkey") % 200, _LAMBERT)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


# what goes with a map of a cube
_MAPPED = {"prcp": "mm/h", "t2": "K", "psfc": "Pa", "et": "mm/h", "potevap": "mm/h"}


@query('SELECT j, i, round(avg(w) * 24, 6) AS prcp, round(avg(w) - 273.15, 6) AS t2, round(avg(w) * 0.01, 6) AS psfc, round(avg(w) * 24, 6) AS et, round(avg(w) * 24, 6) AS potevap FROM cube GROUP BY 1, 2')
def map_units(spark, d):
    """A map's mean in the unit that maps of each variable have."""
    mean = reduce.temporal_mean(cube(spark, d), ["w"])
    return mean.select("j", "i", *[F.round(units.convert(F.col("w"), u, k), 6).alias(k) for k, u in _MAPPED.items()])


@query("""SELECT c."time", c.j, c.i, c.level, round(c.v, 2) AS v, round(u.u10, 4) AS u10, round(u.v10, 4) AS v10 FROM cube c
JOIN (SELECT "time", j, i, avg(w) AS u10, avg(-w / 2) AS v10 FROM cube GROUP BY 1, 2, 3) u ON c."time" = u."time" AND c.j = u.j AND c.i = u.i""")
def attach_wind(spark, d):
    """A field and the wind at all its times and cells, of which none may be missing."""
    c = cube(spark, d)
    wind = c.groupBy("time", "j", "i").agg(F.avg("w").alias("u10"), F.avg(-F.col("w") / 2).alias("v10"))
    return rounded(rounded(joins.attach(c.drop("w"), wind), 2, "v"), 4, "u10", "v10")


@query('SELECT c."time", j, i, level, v FROM cube c WHERE CAST(c."time" AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders) AND c."time" IN (SELECT "time" FROM cube WHERE level = 1)')
def exact_times(spark, d):
    """A cube at the times of another, its first level at the days that orders have; an error if one is missing."""
    c = cube(spark, d)
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("_day")).distinct()
    other = select.level(c, 1).join(days, F.to_date("time") == F.col("_day"), "left_semi")
    return select.exact_times(c, other).select("time", "j", "i", "level", "v")


@query("SELECT c.j, c.i, count(*) AS n, count(CASE WHEN g.hgt BETWEEN 300 AND 1800 THEN v END) AS n_v FROM cube c JOIN field g ON c.j = g.j AND c.i = g.i GROUP BY 1, 2")
def altitude_range(spark, d):
    """Values of cells within heights, both ends included."""
    zone = masks.where_grid(cube(spark, d), field(spark, d), F.col("hgt").between(300, 1800))
    return zone.groupBy("j", "i").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_v"))


@query("SELECT k, round((200 + k % 7 * 300) / 111000.0 / cos(radians(lat)), 9) AS dlon, round((200 + k % 7 * 300) / 111000.0, 9) AS dlat FROM places")
def degree_resolution(spark, d):
    dlon, dlat = regrid.degrees_of(200 + F.col("k") % 7 * 300, F.col("lat"))
    return places(spark, d).select("k", F.round(dlon, 9).alias("dlon"), F.round(dlat, 9).alias("dlat"))


@query('SELECT DISTINCT CAST(year("time") AS INT) AS year FROM cube')
def distinct_years(spark, d):
    return reduce.years(cube(spark, d))


# names
@query("""SELECT v.name, CASE lower(v.name) WHEN 'prcp' THEN 'prcp,PCP' WHEN 't2' THEN 't2,T' WHEN 'rh' THEN 'rh,RH' WHEN 'q' THEN 'q2,q' END AS names, CASE v.name WHEN 't2' THEN 'T' WHEN 'prcp' THEN 'PCP_tot_bucket,PCP_diff_radar,PCP_diffmin_radar,PCP_acoustic' END AS sensors, count(*) AS n
FROM (SELECT CASE user_id % 6 WHEN 0 THEN 'prcp' WHEN 1 THEN 'T2' WHEN 2 THEN 't2' WHEN 3 THEN 'rh' WHEN 4 THEN 'Q' ELSE event_type END AS name FROM events) v GROUP BY 1, 2, 3""")
def sensor_alias_map(spark, d):
    """Names that observations come under, and how many do."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("prcp", "T2", "t2", "rh", "Q")], F.col("event_type")), (F.col("user_id") % 6 + 1).cast("int"))
    v = table(spark, d, "events").select(name.alias("name"))
    joined = lambda c: F.when(c.isNotNull(), F.concat_ws(",", c))
    return v.select("name", joined(units.names_column(F.col("name"))).alias("names"), joined(units.sensors_column(F.col("name"))).alias("sensors")).groupBy("name", "names", "sensors").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT v.name, station FROM (SELECT 'AWS-P_' || CASE c_custkey % 4 WHEN 0 THEN 'El_JUNCO' WHEN 1 THEN 'cerro_crocker' WHEN 2 THEN 'sierranegra' ELSE 'nowhere' END || '_' || c_custkey AS name FROM customer) v
LEFT JOIN {_STATIONS} ON contains(lower(v.name), lower(string_split(station, ' ')[-1]))""")
def station_name_match(spark, d):
    word = F.element_at(F.array(*[F.lit(x) for x in ("El_JUNCO", "cerro_crocker", "sierranegra", "nowhere")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    v = table(spark, d, "customer").select(F.concat(F.lit("AWS-P_"), word, F.lit("_"), F.col("c_custkey")).alias("name"))
    return joins.match_station(v, joins.stations(spark)).select("name", "station")


@query("""SELECT y AS year, m AS month, CAST(dayofyear(make_date(y, m, 1)) - 1 AS INT) AS doy FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders)""")
def first_doy_of_month(spark, d):
    ym = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return ym.select("year", "month", calendar.first_day_of_month(F.col("year"), F.col("month")).alias("doy"))


@query("""SELECT p_partkey, k, unit, CASE WHEN starts_with(unit, 'months') THEN CAST(make_date(2023 + k // 12, k % 12 + 1, 1) - make_date(2023, 1, 1) AS DOUBLE) ELSE CAST(k AS DOUBLE) END AS value,
CASE WHEN unit[1:5] IN ('month', 'years') THEN 'days since 2023-01-01' ELSE unit END AS new_unit
FROM (SELECT p_partkey, CAST(p_size AS INT) AS k, ['months since 2023-01-01', 'years since 2023-01-01', 'hours since 2023-01-01'][p_partkey % 3 + 1] AS unit FROM part)""")
def time_axis_correction(spark, d):
    unit = F.element_at(F.array(*[F.lit(f"{u} since 2023-01-01") for u in ("months", "years", "hours")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("k"), unit.alias("unit"))
    value, new = calendar.corrected_time(F.col("k"), F.col("unit"))
    return rows.select("p_partkey", "k", "unit", value.alias("value"), new.alias("new_unit"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents")
def normalize_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(names.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT p_partkey, regexp_replace(p_name || ' #' || p_type, '[^\\p{L}\\p{N}]', '', 'g') AS name FROM part")
def strip_non_alnum(spark, d):
    return table(spark, d, "part").select("p_partkey", names.strip_non_alnum(F.concat("p_name", F.lit(" #"), "p_type")).alias("name"))


@query("SELECT p_partkey, translate(CAST(-p_size AS VARCHAR), '-0123456789', '⁻⁰¹²³⁴⁵⁶⁷⁸⁹') AS exponent FROM part")
def superscript_exponent(spark, d):
    return table(spark, d, "part").select("p_partkey", names.superscript(-F.col("p_size")).alias("exponent"))


@query("SELECT p_partkey, array_to_string(string_split(a, CASE WHEN contains(a, ',') THEN ',' ELSE ' ' END), '|') AS parts FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ',' || p_brand ELSE p_type || ' ' || p_size END AS a FROM part)")
def split_attribute(spark, d):
    a = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(","), "p_brand")).otherwise(F.concat("p_type", F.lit(" "), F.col("p_size")))
    return table(spark, d, "part").select("p_partkey", F.concat_ws("|", names.split_attribute(a)).alias("parts"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '+k_0=1.0 +units=m +lat_0=2.0 +lon_0=-90.31006622 +x_0=0.0 +y_0=0.0 +ellps=WGS84 +datum=WGS84 +name=WRFMercator +proj=merc +no_defs'
ELSE '+k_0=1.0 +units=m +lat_0=' || p_size || '.5 +lon_0=-' || p_size || '.25 +x_0=0.0 +y_0=0.0 +ellps=WGS84 +datum=WGS84 +name=WRFMercator +proj=merc +no_defs' END AS srs FROM part""")
def proj_string(spark, d):
    size = F.col("p_size").cast("string")
    envi = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("{3, 6370000, 6370000, "), size, F.lit(".5, -"), size, F.lit(".25, 0.0, 0.0, WGS-84, WRF Mercator}")))
    return table(spark, d, "part").select("p_partkey", envi.alias("envi")).select("p_partkey", names.envi_projection(F.col("envi")).alias("srs"))


@query("""SELECT o_custkey, 'trend_' || CASE WHEN o_custkey % 2 = 0 THEN 'hgt-0-2000' ELSE 'p-500-850' END || '_v-t2-' || o_orderstatus || '_y-' || year(min(o_orderdate)) || '-' || year(max(o_orderdate)) || '_masksea' AS stem FROM orders GROUP BY o_custkey, o_orderstatus""")
def file_stem(spark, d):
    ends = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    levels = F.when(F.col("o_custkey") % 2 == 1, F.array(F.lit(500), F.lit(850)))
    return ends.select("o_custkey", names.file_stem_column(F.lit("trend"), F.array(F.lit("t2"), F.col("o_orderstatus")), F.col("a"), F.col("z"), levels, mask_sea=True).alias("stem"))


@query("SELECT station, printf('%.2f', abs(slon)) || '°' || CASE WHEN slon < 0 THEN 'W' ELSE 'E' END AS lon, printf('%.2f', abs(slat)) || '°' || CASE WHEN slat < 0 THEN 'S' ELSE 'N' END AS lat FROM " + _POINTS)
def lon_lat_label(spark, d):
    x, y = domains.web_mercator(F.col("lon"), F.col("lat"))
    return sites(spark, d).select("station", names.lon_lat_label(x, "lon").alias("lon"), names.lon_lat_label(y, "lat").alias("lat"))


@query(_Y + f"SELECT printf('ȳ = %.1f mm', a) || ' | ' || printf('β = %.3f mm a⁻¹', s) || ' | ' || printf('R² = %.2f', r) || ' | p > 0.05' AS label FROM (SELECT avg(v) AS a, regr_slope(v, year) AS s, regr_r2(v, year) AS r FROM y)")
def regression_label(spark, d):
    y = _yearly(spark, d)
    fit = regression.ols(y, "v", "year").join(F.broadcast(y.agg(F.avg("v").alias("mean"))))  # one row each
    return fit.select(names.regression_label(F.col("mean"), F.col("slope"), F.col("r2"), F.abs("t") > 2.570582, "mm/d").alias("label"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size * 1.0 END, p_retailprice) AS dx FROM part")
def grid_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", names.grid_distance(F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 1.0), F.col("p_retailprice"), "x").alias("dx"))
