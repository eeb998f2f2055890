"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubewind.llm.tables import discard, keep


def _least(both: DataFrame) -> DataFrame:
    """u, v and the least of u and all its v; the minimum is formed before the shuffle, so a hub isn't a hot key."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["_u"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns id, component (the smallest id that links reach) for each id that has a link."""
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, edges = edges, keep(small.where("u <> v").distinct(), "stars")
        discard(before)
        # done when no root has a root of its own, and no id two roots
        roots = edges.select(F.col("v").alias("_v")).distinct()
        deep = edges.join(roots, edges["u"] == roots["_v"], "left_semi")
        twice = edges.groupBy("u").count().where("count > 1")
        if deep.isEmpty() and twice.isEmpty():
            break
    own = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = keep(own.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    discard(edges)
    return out
