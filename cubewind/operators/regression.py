"""Linear regression by aggregates, windows and array expressions; only quantiles of Student's t are NumPy, a row per fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIGNIFICANT = 0.05


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised, by the continued fraction, of whole arrays."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.clip(np.where(turned, 1 - x, x), 1e-300, 1 - 1e-16)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    some = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(x), 1 / some(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / some(1 + top * d)
            c = some(1 + top / c)
            out *= c * d
        if not len(np.atleast_1d(out)) or np.abs(c * d - 1).max() < 1e-14:
            break
    return np.where(turned, 1 - front * out, front * out)


def p_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided, of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    fine = (df > 0) & ~np.isnan(t)
    safe = np.where(fine, df, 1.0)
    return np.where(fine, incomplete_beta(safe / 2, 0.5, safe / (safe + np.where(fine, t, 0.0) ** 2)), 1.0)


def p_value(t: float, df: float) -> float:
    return float(p_values(t, df))


def critical_ts(df: np.ndarray, p: float = SIGNIFICANT) -> np.ndarray:
    """Where the two-sided p-value of Student's t is p: by halving, of all degrees of freedom at once."""
    df = np.asarray(df, float)
    low, high = np.zeros(len(df)), np.full(len(df), 1e4)
    for _ in range(80):
        mid = (low + high) / 2
        over = p_values(mid, df) > p
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    return np.where(df > 0, high, np.nan)


def critical_t(df: float, p: float = SIGNIFICANT) -> float:
    return float(critical_ts(np.array([df]), p)[0])


def t_column(df: Column, p: float = SIGNIFICANT) -> Column:
    """critical_t over a column of degrees of freedom, once for each that a batch has; NULL without any."""

    @F.pandas_udf("double")
    def t(df: pd.Series) -> pd.Series:
        each = df.dropna().unique()
        return df.map(dict(zip(each, critical_ts(each, p), strict=True))).astype(float).where(df > 0, None)

    return t(df.cast("double"))


def p_column(t: Column, df: Column) -> Column:
    """p_value over columns; the frames that reach it are one row per fit."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(p_values(t.to_numpy(float), df.to_numpy(float))).where((t.notna() & df.notna()).to_numpy(), None)

    return p(t, df)


def ols(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, slope, intercept, r2, t. Rows where either is NULL are left out; t is NULL for a perfect fit or n < 3."""
    b, a = F.col(y), F.col(x)
    fit = df.groupBy(*by).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"),
        F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("sxy"),
    )
    rest = F.col("syy") - F.col("slope") * F.col("sxy")
    t = F.when((rest > 1e-12 * F.col("syy")) & (F.col("n") > 2), F.col("slope") * F.sqrt((F.col("n") - 2) * F.col("sxx") / rest))
    return fit.withColumn("t", t).drop("sxx", "syy", "sxy")


def with_p(fit: DataFrame) -> DataFrame:
    return fit.withColumn("p", p_column(F.col("t"), (F.col("n") - 2).cast("double")))


def trend_map(yearly: DataFrame, y: str) -> DataFrame:
    """Slope per cell. A cell with a missing year has no slope, one without any value isn't in the map."""
    agg = yearly.groupBy("j", "i").agg(
        F.count(F.lit(1)).alias("_all"), F.regr_count(F.col(y), F.col("year")).alias("n"), F.regr_slope(F.col(y), F.col("year")).alias("slope"),
        F.regr_sxx(F.col(y), F.col("year")).alias("sxx"), F.regr_syy(F.col(y), F.col("year")).alias("syy"), F.regr_sxy(F.col(y), F.col("year")).alias("sxy"),
    )
    full = F.col("n") == F.col("_all")
    rest = F.col("syy") - F.col("slope") * F.col("sxy")
    t = F.when(full & (rest > 1e-12 * F.col("syy")) & (F.col("n") > 2), F.col("slope") * F.sqrt((F.col("n") - 2) * F.col("sxx") / rest))
    return agg.where("n > 0").select("j", "i", "n", F.when(full, F.col("slope")).alias("slope"), t.alias("t"))


def significant(fit: DataFrame, p: float = SIGNIFICANT) -> DataFrame:
    """Fits whose two-sided p-value is below p, whatever their number of points."""
    return fit.where(F.col("t").isNotNull() & (p_column(F.col("t"), (F.col("n") - 2).cast("double")) < p))


def adjusted(fit: DataFrame, p: str = "p", parts: int = 200) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values of a map of fits, which is read a few times. Distinct p-values are dealt to `parts`
    bins of about as many each, whose bounds a quantile sketch gives: a map full of signal has nearly all of them close to 0.
    Counts and least quotients of the bins, a row each, give every bin its offsets, so that no task sees all fits."""
    equal = fit.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_c"))
    bounds = equal.agg(F.percentile_approx(p, F.array(*[F.lit(k / parts) for k in range(1, max(parts, 2))]), F.lit(20 * parts)).alias("_bounds"))
    same = equal.join(F.broadcast(bounds)).withColumn("_bin", F.size(F.filter("_bounds", lambda b: b < F.col(p)))).drop("_bounds")  # one row
    bins = same.groupBy("_bin").agg(F.sum("_c").alias("_in"))
    below = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # over `parts` rows
    bins = bins.select("_bin", F.coalesce(F.sum("_in").over(below), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy()).alias("_m"))
    # as in rank(): the first place of equal values
    ranked = same.join(F.broadcast(bins), "_bin").withColumn("_r", F.col("_before") + F.sum("_c").over(Window.partitionBy("_bin").orderBy(p)) - F.col("_c") + 1)
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    down = Window.partitionBy("_bin").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    least = ranked.groupBy("_bin").agg(F.min("_q").alias("_least"))
    above = least.select("_bin", F.min("_least").over(Window.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))  # over `parts` rows
    values = ranked.withColumn("_q", F.min("_q").over(down)).join(F.broadcast(above), "_bin").select(p, F.least("_q", "_above", F.lit(1.0)).alias("p_adjusted"))
    return fit.join(values, p, "left").select(*fit.columns, "p_adjusted")


def residuals(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Fitted values and what is left; the fits are aggregated before they meet the rows again."""
    fits = df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("_s"), F.regr_intercept(F.col(y), F.col(x)).alias("_c"))
    out = df.join(fits, list(by), "left") if by else df.join(F.broadcast(fits))  # one row
    out = out.withColumn("fitted", F.col("_c") + F.col("_s") * F.col(x)).withColumn("residual", F.col(y) - F.col("fitted"))
    return out.select(*df.columns, "fitted", "residual")


def trend_line(fit: DataFrame, low: float, high: float, points: int = 100) -> DataFrame:
    """Each fit at evenly spaced x."""
    x = F.lit(low) + F.col("k") * F.lit((high - low) / (points - 1))
    return fit.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x).withColumn("y", F.col("intercept") + F.col("slope") * F.col("x"))


def prediction_band(df: DataFrame, y: str, x: str, critical: float | None = None, by: Sequence[str] = (), p: float = SIGNIFICANT) -> DataFrame:
    """The fitted mean at each x and its confidence band, by series. The quantile of Student's t is that of each series' length
    unless `critical` is given; fewer than three points have no band."""
    a, b = F.col(x), F.col(y)
    fit = df.groupBy(*by).agg(F.regr_count(b, a).alias("_n"), F.regr_slope(b, a).alias("_s"), F.regr_intercept(b, a).alias("_c"), F.regr_avgx(b, a).alias("_m"), F.regr_sxx(b, a).alias("_xx"), F.regr_syy(b, a).alias("_yy"), F.regr_sxy(b, a).alias("_xy"))
    fit = fit.withColumn("_t", F.lit(critical) if critical is not None else t_column(F.col("_n") - 2, p))
    out = df.join(fit, list(by), "left") if by else df.join(F.broadcast(fit))  # one row
    spread = F.sqrt(F.greatest(F.col("_yy") - F.col("_s") * F.col("_xy"), F.lit(0.0)) / F.nullif(F.col("_n") - 2, F.lit(0)))
    half = F.when(F.col("_n") > 2, F.col("_t") * spread * F.sqrt(1 / F.col("_n") + F.pow(a - F.col("_m"), 2) / F.nullif(F.col("_xx"), F.lit(0.0))))
    mean = F.col("_c") + F.col("_s") * a
    return out.select(*df.columns, mean.alias("fitted"), (mean - half).alias("low"), (mean + half).alias("high"))


#: Huber's constant, the third quartile of the normal distribution, and steps of reweighting at most
HUBER, QUARTILE, STEPS = 1.345, 0.6744897501960817, 50
#: Variances that a line makes negative or nearly 0 count as this share of the largest
FLOOR = 1e-6


def _moments(weight: Column, one: Column, x: Column, y: Column) -> dict[str, Column]:
    """Sums that a weighted line needs; one: the constant's column."""
    both = {"aa": one * one, "ax": one * x, "xx": x * x, "ay": one * y, "xy": x * y, "yy": y * y}
    return {k: F.sum(weight * c) for k, c in both.items()}


def _line(by: Sequence[str], sums: DataFrame) -> DataFrame:
    """Slope, intercept and t from sums over x and y that are counted from their means _mx and _my."""
    c = F.col
    rank = c("aa") * c("xx") - c("ax") * c("ax")
    slope = (c("aa") * c("xy") - c("ax") * c("ay")) / rank
    start = (c("xx") * c("ay") - c("ax") * c("xy")) / rank
    rest = F.greatest(c("rest") if "rest" in sums.columns else c("yy") - start * c("ay") - slope * c("xy"), F.lit(0.0))
    t = F.when((rest > 1e-12 * c("yy")) & (c("n") > 2), slope * F.sqrt((c("n") - 2) * rank / (c("aa") * rest)))
    fine = (c("n") > 2) & (rank > 0) & ~F.isnan(rank)
    return sums.select(*by, "n", F.when(fine, slope).alias("slope"), F.when(fine, c("_my") + start - slope * c("_mx")).alias("intercept"), F.when(fine, t).alias("t"))


def _centred(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """by, _x and _y counted from their means, and the means: one shuffle by the series' key, which later windows share."""
    own = Window.partitionBy(*by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.withColumns({"_mx": F.avg("_x").over(own), "_my": F.avg("_y").over(own)})
    return rows.withColumns({"_x": F.col("_x") - F.col("_mx"), "_y": F.col("_y") - F.col("_my")})


def _with_rest(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """_e: what a plain line leaves of centred values."""
    own = Window.partitionBy(*by)
    slope = F.sum(F.col("_x") * F.col("_y")).over(own) / F.nullif(F.sum(F.col("_x") * F.col("_x")).over(own), F.lit(0.0))
    return rows.withColumn("_e", F.col("_y") - slope * F.col("_x"))


def _means() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my")]


def gls_ar1(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Generalised least squares with errors that follow one another by a factor, that of the plain fit's residuals. The inverse
    of their covariance has three diagonals: each value less the factor times the one before, the first one scaled, is a plain
    fit. Windows over the series in order; nothing of n x n, and one shuffle for all series."""
    own, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_x")
    rows = _with_rest(_centred(df, y, x, by), by)
    rows = rows.withColumn("_b", F.lag("_e").over(line))
    rows = rows.withColumn("_r", F.coalesce(F.sum(F.col("_e") * F.col("_b")).over(own) / F.nullif(F.sum(F.col("_e") * F.col("_e")).over(own), F.lit(0.0)), F.lit(0.0)))
    first = F.row_number().over(line) == 1
    turned = lambda c: F.when(first, F.sqrt(1 - F.col("_r") * F.col("_r")) * c).otherwise(c - F.col("_r") * F.lag(c).over(line))
    rows = rows.select(*by, "_mx", "_my", turned(F.lit(1.0)).alias("_1"), turned(F.col("_x")).alias("_x"), turned(F.col("_y")).alias("_y"))
    sums = _moments(F.lit(1.0), F.col("_1"), F.col("_x"), F.col("_y"))
    return _line(by, rows.groupBy(*by).agg(*_means(), *[c.alias(k) for k, c in sums.items()]))


def gls_hs(df: DataFrame, y: str, x: str, by: Sequence[str] = (), mode: str = "textbook") -> DataFrame:
    """Weighted by the variance that a line through the squared residuals has at each x; mode 'inverted' by its inverse."""
    own = Window.partitionBy(*by)
    rows = _with_rest(_centred(df, y, x, by), by).withColumn("_e", F.col("_e") * F.col("_e"))
    slope = F.sum(F.col("_x") * F.col("_e")).over(own) / F.nullif(F.sum(F.col("_x") * F.col("_x")).over(own), F.lit(0.0))
    rows = rows.withColumn("_v", F.avg("_e").over(own) + slope * F.col("_x"))
    rows = rows.withColumn("_v", F.greatest(F.col("_v"), FLOOR * F.greatest(F.max("_v").over(own), F.lit(1e-300))))
    rows = rows.withColumn("_w", F.col("_v") if mode == "inverted" else 1 / F.col("_v"))
    c, sums = F.col, _moments(F.col("_w"), F.lit(1.0), F.col("_x"), F.col("_y"))
    rows = rows.withColumns({k: x.over(own) for k, x in sums.items()})
    rank = F.nullif(c("aa") * c("xx") - c("ax") * c("ax"), F.lit(0.0))
    rows = rows.withColumns({"_s": (c("aa") * c("xy") - c("ax") * c("ay")) / rank, "_c": (c("xx") * c("ay") - c("ax") * c("xy")) / rank})
    # what the line leaves is summed up itself: differences of sums lose it where weights differ much
    rest = F.sum(c("_w") * F.pow(c("_y") - c("_c") - c("_s") * c("_x"), 2))
    return _line(by, rows.groupBy(*by).agg(*_means(), *[F.first(k).alias(k) for k in sums], rest.alias("rest")))


def _series(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per series with its points in order: one value per day of decades at most."""
    return rows.groupBy(*by).agg(*_means(), F.array_sort(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))).alias("_s"))


def gls_ar1_inverted(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """As gls_ar1, but weighted by the covariance as if it were its inverse. The weights r ** |i - j| of all pairs of a series sum
    up in one pass that carries what earlier values still count for."""
    rows = _with_rest(_centred(df, y, x, by), by).withColumn("_b", F.lag("_e").over(Window.partitionBy(*by).orderBy("_x")))
    factor = F.coalesce(F.sum(F.col("_e") * F.col("_b")) / F.nullif(F.sum(F.col("_e") * F.col("_e")), F.lit(0.0)), F.lit(0.0))
    each = rows.groupBy(*by).agg(*_means(), F.array_sort(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))).alias("_s"), factor.alias("_r"))
    names = ("p1", "px", "py", "aa", "ax", "xx", "ay", "xy", "yy")

    def step(s: Column, v: Column) -> Column:
        one, x, y, p1, px, py, r = F.lit(1.0), v["x"], v["y"], s["p1"], s["px"], s["py"], F.col("_r")
        pair = lambda a, b, pa, pb: a * b + a * pb + b * pa
        new = [r * (one + p1), r * (x + px), r * (y + py), s["aa"] + pair(one, one, p1, p1), s["ax"] + pair(one, x, p1, px), s["xx"] + pair(x, x, px, px), s["ay"] + pair(one, y, p1, py), s["xy"] + pair(x, y, px, py), s["yy"] + pair(y, y, py, py)]
        return F.struct(*[c.alias(k) for k, c in zip(names, new, strict=True)])

    sums = each.withColumn("_t", F.aggregate("_s", F.struct(*[F.lit(0.0).alias(k) for k in names]), step))
    return _line(by, sums.select(*by, "n", "_mx", "_my", *[F.col("_t")[k].alias(k) for k in names[3:]]))


def robust(df: DataFrame, y: str, x: str, by: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """Lines by Huber's weights, refitted `steps` times or until they stay: of all series at once, each in its own row. The scale
    is the median of the residuals' sizes about 0; the weights of a step are those of the line before."""
    each = _series(_centred(df, y, x, by), by)
    values = F.col("_s")

    def weight(v: Column, s: Column, scale: Column) -> Column:
        return F.least(F.lit(1.0), HUBER / F.greatest(F.abs(v["y"] - s["c"] - s["s"] * v["x"]) / scale, F.lit(1e-12)))

    def scale_of(s: Column) -> Column:
        sizes = F.array_sort(F.transform(values, lambda v: F.abs(v["y"] - s["c"] - s["s"] * v["x"])))
        n = F.size(sizes)
        median = (F.get(sizes, F.floor((n - 1) / 2).cast("int")) + F.get(sizes, F.floor(n / 2).cast("int"))) / 2
        found = median / QUARTILE
        return F.when(found > 0, found).otherwise(1e-12)

    names = ("aa", "ax", "xx", "ay", "xy", "yy")

    def sums_of(s: Column) -> Column:
        """The sums under the weights of a line; its scale is found once, as an element that the fold meets."""
        zero = F.struct(*[F.lit(0.0).alias(k) for k in names])

        def add(scale: Column):
            def go(t: Column, v: Column) -> Column:
                w = weight(v, s, scale)
                both = (w, w * v["x"], w * v["x"] * v["x"], w * v["y"], w * v["x"] * v["y"], w * v["y"] * v["y"])
                return F.struct(*[(t[k] + c).alias(k) for k, c in zip(names, both, strict=True)])

            return go

        return F.get(F.transform(F.array(scale_of(s)), lambda scale: F.aggregate(values, zero, add(scale))), F.lit(0))

    state = lambda s, c, done, t: F.struct(s.alias("s"), c.alias("c"), done.alias("done"), *[t[k].alias(k) for k in names])

    def refit(s: Column, _: Column) -> Column:
        def solved(t: Column) -> Column:
            rank = F.nullif(t["aa"] * t["xx"] - t["ax"] * t["ax"], F.lit(0.0))
            slope, start = (t["aa"] * t["xy"] - t["ax"] * t["ay"]) / rank, (t["xx"] * t["ay"] - t["ax"] * t["xy"]) / rank
            return state(slope, start, F.coalesce(F.greatest(F.abs(slope - s["s"]), F.abs(start - s["c"])) < 1e-10, F.lit(True)), t)

        return F.when(s["done"], s).otherwise(F.get(F.transform(F.array(sums_of(s)), solved), F.lit(0)))

    plain = F.aggregate(values, F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy")), lambda t, v: F.struct((t["xx"] + v["x"] * v["x"]).alias("xx"), (t["xy"] + v["x"] * v["y"]).alias("xy")))
    each = each.withColumn("_p", plain)
    nothing = F.struct(*[F.lit(0.0).alias(k) for k in names])
    first = state(F.coalesce(F.col("_p.xy") / F.nullif(F.col("_p.xx"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0), F.lit(False), nothing)
    each = each.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, refit))
    return _line(by, each.select(*by, "n", "_mx", "_my", *[F.col("_f")[k].alias(k) for k in names]))


def fit(df: DataFrame, y: str, x: str, by: Sequence[str] = (), model: str = "ols", mode: str = "textbook") -> DataFrame:
    """by, n, slope, intercept, t of 'ols', 'gls-ar1', 'gls-hs' or 'rls', of all series by their key. mode 'inverted' weighs by
    the covariance as if it were its inverse. Rows where x or y is NULL are left out; fewer than three points, or one x, have no
    line, and a perfect fit no t."""
    if model == "ols":
        return ols(df, y, x, by).drop("r2")
    if model == "gls-ar1":
        return (gls_ar1_inverted if mode == "inverted" else gls_ar1)(df, y, x, by)
    if model == "gls-hs":
        return gls_hs(df, y, x, by, mode)
    if model == "rls":
        return robust(df, y, x, by)
    raise ValueError(f"unknown model {model}")
