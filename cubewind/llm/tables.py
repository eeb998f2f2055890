"""Tables that cut lineage: Parquet in the shared folder, so that a lost executor loses nothing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset, as in tests, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "cubewind-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and later stages don't depend on executors."""
    spark = df.sparkSession
    df.write.parquet(path := place(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*kept: DataFrame) -> None:
    """Delete tables of keep() that nothing reads any more."""
    for df in kept:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    names = {c.lower() for c in docs.columns}
    while name.lower() in names:
        name += "_"
    return name


def located(docs: DataFrame, name: str) -> DataFrame:
    """docs with the column `name`, where each row is: a hash of its file and its number in it. Unlike doc_id it is never null
    and never repeated. What isn't read from files is written first."""

    def at(df: DataFrame) -> DataFrame:
        return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))

    try:
        return at(docs)
    except AnalysisException:
        return at(keep(docs, "located"))


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """rows, a written table, left-joined with groups, one row per key with the number of its rows in `size`. Groups of more
    rows than a share of all are broadcast, so no key is a hot one; there can't be more than 50,000 of them."""
    hot = max(1000, rows.count() // 50_000)
    large = groups.where(F.col(size) > hot)
    head = rows.join(F.broadcast(large), key)
    tail = rows.join(F.broadcast(large.select(*key)), key, "left_anti").join(groups.where(F.col(size) <= hot), key, "left")
    return head.unionByName(tail)


#: Rows of a batch that a worker gets at once, unless the session says otherwise: texts are long.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over small batches, after which a worker gives free memory back: later stages reuse it."""
    if df.sparkSession.conf.get(_ROWS) == "10000":  # the default
        df.sparkSession.conf.set(_ROWS, str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
