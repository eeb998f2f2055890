"""Bins of a stream of observations: the streaming side of daily resampling. Days without rows aren't made up here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(stream: DataFrame, value: str, by: Sequence[str], time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """by, bin, sum, mean, n; a bin is final when the watermark has passed it."""
    bins = stream.withWatermark(time, late).groupBy(*by, F.window(time, width).alias("_w"))
    return bins.agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.count(value).alias("n")).select(*by, F.col("_w.start").alias("bin"), "sum", "mean", "n")


def run_available(binned_stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that is there and stop; run again, it goes on where it was."""
    query = binned_stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
