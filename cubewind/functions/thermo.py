"""Moisture of air, and buoyant energy of a lifted parcel."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 0.622
_RD, _CP, _G = 287.04, 1004.0, 9.81


def specific_humidity(mixing_ratio: Column) -> Column:
    """g/kg from kg/kg."""
    return mixing_ratio / (1 + mixing_ratio) * 1000


def saturation_pressure(kelvin: Column) -> Column:
    """hPa, Bolton (1980)."""
    c = kelvin - 273.15
    return 6.112 * F.exp(17.67 * c / (c + 243.5))


def relative_humidity(pressure_hpa: Column, kelvin: Column, mixing_ratio: Column) -> Column:
    """Share of the saturation mixing ratio."""
    es = saturation_pressure(kelvin)
    return mixing_ratio / (EPSILON * es / (pressure_hpa - es))


def equivalent_potential(pressure_hpa: Column, kelvin: Column, mixing_ratio: Column, lcl: Column) -> Column:
    """Equivalent potential temperature, Bolton (1980), of air that condenses at the temperature lcl."""
    q = mixing_ratio
    return kelvin * F.pow(1000 / pressure_hpa, 0.2854 * (1 - 0.28 * q)) * F.exp((3376 / lcl - 2.54) * q * (1 + 0.81 * q))


def condensation_temperature(pressure_hpa: Column, kelvin: Column, mixing_ratio: Column) -> Column:
    """K at which lifted air condenses, Bolton (1980); that of the air itself if it has already."""
    e = mixing_ratio * pressure_hpa / (EPSILON + mixing_ratio)
    return F.least(2840 / (3.5 * F.log(kelvin) - F.log(e) - 4.805) + 55, kelvin)


#: Newton's steps down a pseudo-adiabat
NEWTON = 10


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def pseudo_adiabat(theta_e: Column, pressure_hpa: Column) -> Column:
    """Temperature of saturated air of an equivalent potential temperature at a pressure. From above, where the dry adiabat is,
    Newton's steps come down without passing it; an expression without a table or Python. A step needs one exponential and one
    logarithm, and stays small enough for the code around it to be compiled."""

    def down(x: Column) -> Column:
        def step(t: Column, _: Column) -> Column:
            def newton(q: Column) -> Column:
                heat, growth = 3376 / t - 2.54, q * (1 + q / EPSILON) * (17.67 * 243.5) / ((t - 29.65) * (t - 29.65))
                value = F.log(t) + (1 - 0.28 * q) * x["lift"] + heat * q * (1 + 0.81 * q)
                slope = 1 / t - 0.28 * x["lift"] * growth - 3376 / (t * t) * q * (1 + 0.81 * q) + heat * (1 + 1.62 * q) * growth
                return t - (value - x["goal"]) / slope

            # the saturation mixing ratio, with t in one place
            return _named(EPSILON / (x["p"] * F.exp(17.67 * 243.5 / (t - 29.65) - 17.67) - 1), newton)

        return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), x["first"], step)

    first = F.least(theta_e * F.pow(pressure_hpa / 1000, F.lit(0.2854)), F.lit(320.0))
    return _named(F.struct(F.log(theta_e).alias("goal"), (0.2854 * F.log(1000 / pressure_hpa)).alias("lift"), (pressure_hpa / 6.112).alias("p"), first.alias("first")), down)


def virtual_temperature(kelvin: Column, mixing_ratio: Column) -> Column:
    return kelvin * (EPSILON + mixing_ratio) / (EPSILON * (1 + mixing_ratio))


def cape(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cape and cin (J/kg) of profiles: keys, p (hPa), t (K), q (kg/kg), a row per level.

    The parcel is the mean of the 500 m around the level of the greatest equivalent potential temperature in the lowest 3 km: it
    rises along a dry adiabat to where it condenses, then along a pseudo-adiabat. Buoyancy is linear between levels; CAPE is what
    is positive, CIN what is negative below that, 0 where nothing is positive. Levels with a missing or non-finite value are left
    out; fewer than three levels give NULL. Windows over each column of air: one shuffle by keys, all in the JVM, no join."""
    c, own = F.col, Window.partitionBy(*keys)
    up = own.orderBy(F.desc_nulls_last("p"), "t", "q")
    fine = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(c(x)) < float("inf"))
    rows = profiles.select(*keys, *[c(x).cast("double").alias(x) for x in ("p", "t", "q")])
    rows = rows.withColumn("_fine", fine("p") & fine("t") & fine("q"))
    # levels that are left out become NULL and come last in their column, where they add nothing
    rows = rows.select(*keys, *[F.when(c("_fine"), x).alias(n) for n, x in (("p", c("p")), ("t", c("t")), ("q", F.greatest("q", F.lit(1e-10))))])
    rows = rows.withColumn("tv", virtual_temperature(c("t"), c("q")))
    rows = rows.withColumn("dz", F.coalesce(_RD / _G * (c("tv") + F.lag("tv").over(up)) / 2 * F.log(F.lag("p").over(up) / c("p")), F.lit(0.0)))
    rows = rows.withColumn("z", F.sum("dz").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("the", equivalent_potential(c("p"), c("t"), c("q"), condensation_temperature(c("p"), c("t"), c("q"))))
    source = F.max(F.when(c("p").isNotNull() & (c("z") <= 3000), F.struct(c("the"), (-c("z")).alias("z"), c("p")))).over(own)
    rows = rows.withColumns({"_s": source, "_n": F.count("p").over(own)})
    near = (F.abs(c("z") - F.greatest(-c("_s.z"), F.lit(250.0))) <= 250) | (c("z") == -c("_s.z"))
    theta = c("t") * F.pow(1000 / c("p"), F.lit(_RD / _CP))
    rows = rows.withColumns({"pk": c("_s.p"), "qk": F.avg(F.when(near, c("q"))).over(own), "_th": F.avg(F.when(near, theta)).over(own)})
    rows = rows.select(*keys, "p", "t", "q", "tv", "dz", "_n", "pk", "qk", (c("_th") * F.pow(c("pk") / 1000, F.lit(_RD / _CP))).alias("tk"))
    rows = rows.withColumn("lcl", condensation_temperature(c("pk"), c("tk"), c("qk")))
    rows = rows.withColumns({"the": equivalent_potential(c("pk"), c("tk"), c("qk"), c("lcl")), "plcl": c("pk") * F.pow(c("lcl") / c("tk"), F.lit(_CP / _RD))}).drop("lcl")
    # below the parcel there is no buoyancy
    rows = rows.withColumn("tp", F.when(c("p") > c("pk"), None).when(c("p") >= c("plcl"), c("tk") * F.pow(c("p") / c("pk"), F.lit(_RD / _CP))).otherwise(pseudo_adiabat(c("the"), c("p"))))
    rows = rows.withColumn("es", saturation_pressure(c("tp")))
    moist = F.when(c("p") >= c("plcl"), c("qk")).otherwise(F.least(EPSILON * c("es") / (c("p") - c("es")), c("qk")))
    rows = rows.withColumn("b", _G * (virtual_temperature(c("tp"), moist) / c("tv") - 1))
    rows = rows.select(*keys, "p", "t", "q", "dz", "_n", "b").withColumn("a", F.lag("b").over(up))
    high, low = F.greatest("a", "b"), F.least("a", "b")
    crossed, both = (c("a") > 0) != (c("b") > 0), c("a").isNotNull() & c("b").isNotNull()
    plus = F.when(crossed, high * high / (2 * (high - low))).otherwise(F.greatest((c("a") + c("b")) / 2, F.lit(0.0))) * c("dz")
    minus = F.when(crossed, -low * low / (2 * (high - low))).otherwise(F.least((c("a") + c("b")) / 2, F.lit(0.0))) * c("dz")
    rows = rows.withColumns({"plus": F.when(both, plus).otherwise(0.0), "minus": F.when(both, minus).otherwise(0.0)})
    below = F.coalesce(F.sum("plus").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) == 0
    rows = rows.withColumn("minus", F.when(below & ~(c("a") > 0), c("minus")).otherwise(0.0))
    sums = rows.groupBy(*keys).agg(F.max("_n").alias("_n"), F.sum("plus").alias("_up"), F.sum("minus").alias("_down"))
    some = c("_n") >= 3
    return sums.select(*keys, F.when(some, c("_up")).alias("cape"), F.when(some, F.when(c("_up") > 0, c("_down")).otherwise(0.0)).alias("cin"))
