"""Exact deduplication over a stream, with DataFrame and SQL functions only.

Texts are equal when they are identical without white space (\\x20, \\x09-\\x0D). A stream over (digest, doc_id, length,
locator) folds every row into RocksDB state keyed by digest: how many rows, and of the one that stays its doc_id and where
its content is. The state has no watermark and never expires, so a later batch still finds what an earlier one left. Rows
that hit a digest are then compared byte by byte with the content that the locator leads to; rows that only share the digest
form groups of their own.

Null texts are empty texts and equal to one another. Of equal texts the one with the most code points stays, then that of the
smallest doc_id, a null last. Of rows that repeat a doc_id with an equal text one stays, whichever comes last in the files. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubewind.llm.tables import delete, discard, keep, located, place, unused, with_groups

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # else each of many small stores reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share this much memory; the rest of the state is on disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}
#: Members of one group that are compared with one copy of the text that stays.
COMPARED = 500


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, at: str) -> DataFrame:
    """What the stream carries of a row: digest of the normalised text, doc_id, code points, locator (in docs under `at`)."""
    return docs.select(F.sha2(normalised(docs["text"]), 256).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.col(at).alias("locator"))


def _rank() -> Column:
    """The greatest stays."""
    return F.struct(F.col("chars"), F.bitwise_not("doc_id").alias("not_id"), F.col("locator"))


def fold(spark: SparkSession, feed: str, schema, state: str, files_per_batch: int | None = None) -> DataFrame:
    """Run all that is in the folder feed through the keyed state; state is the stream's checkpoint and may be used again
    when new files have arrived. Returns digest, keep_id, keep_at (its locator), group_size."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        source = spark.readStream.schema(schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        best = F.max(_rank())
        keyed = source.parquet(feed).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        folded = f"{state}/folded"

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folded}/batch={number}")

        query = keyed.writeStream.outputMode("update").option("checkpointLocation", f"{state}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    put(spark.createDataFrame([], keyed.schema), -1)  # so that there is a table if no row came
    rows = spark.read.schema(keyed.schema).parquet(folded)
    # both only grow from batch to batch
    last = rows.groupBy("digest").agg(F.max("best").alias("best"), F.max("group_size").alias("group_size"))
    return last.select("digest", F.bitwise_not("best.not_id").alias("keep_id"), F.col("best.locator").alias("keep_at"), "group_size")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    at = unused(docs, "_at")
    return _grouped(located(docs, at), at).drop("locator")


def _grouped(docs: DataFrame, at: str) -> DataFrame:
    """The groups with the locator of each row, which docs has under the name `at`."""
    spark = docs.sparkSession
    rows = keep(digests(docs, at), "digests")
    feed = rows.inputFiles()[0].rpartition("/")[0] if not rows.isEmpty() else None
    if feed is None:
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), "locator")
    state = place(spark, "exact-state")
    folded = keep(fold(spark, feed, rows.schema, state), "folded")
    delete(spark, state)
    found = keep(with_groups(rows, folded, ["digest"], "group_size").select("doc_id", "digest", "chars", "locator", "keep_id", "keep_at", "group_size"), "exact-groups")
    discard(rows, folded)

    other = _differing(docs, at, found)
    if not other.isEmpty():  # one digest of two texts
        own = other.groupBy("digest", "norm").agg(F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("n"))
        own = other.join(own, ["digest", "norm"]).select("locator", F.bitwise_not("best.not_id").alias("_id"), F.col("best.locator").alias("_at"), F.col("n").alias("_n"))
        gone = other.groupBy("digest").agg(F.count(F.lit(1)).alias("_gone"))
        found = found.join(own, "locator", "left").join(gone, "digest", "left")
        alone = F.col("_at").isNotNull()
        found = found.withColumn("group_size", F.coalesce("_n", F.col("group_size") - F.coalesce("_gone", F.lit(0))))
        found = found.withColumn("keep_id", F.when(alone, F.col("_id")).otherwise(F.col("keep_id"))).withColumn("keep_at", F.coalesce("_at", "keep_at"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept"), F.col("digest").alias("text_sha256"), "locator")


def _differing(docs: DataFrame, at: str, found: DataFrame) -> DataFrame:
    """Of the rows that share a digest, those whose bytes aren't those of the row that stays: doc_id, digest, chars, locator,
    norm. The text that stays is dealt to as many salts as its group needs, so no group is compared by one task."""
    hits = found.where(F.col("group_size") > 1).select("doc_id", "digest", "chars", "locator", "keep_at", F.ceil(F.col("group_size") / COMPARED).alias("_parts"))
    texts = docs.select(F.col(at).alias("locator"), normalised(docs["text"]).alias("norm")).join(hits, "locator")
    texts = keep(texts.withColumn("_salt", F.pmod(F.xxhash64("locator"), F.col("_parts"))), "exact-hits")
    stays = texts.where(F.col("locator") == F.col("keep_at"))
    stays = stays.select("digest", F.col("norm").alias("_norm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_salt"))
    differ = texts.where(F.col("locator") != F.col("keep_at")).join(stays, ["digest", "_salt"]).where(F.col("norm") != F.col("_norm"))
    out = keep(differ.select("doc_id", "digest", "chars", "locator", "norm"), "exact-differing")
    discard(texts)
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts, the row that stays; its doc_id may be null or that of other rows."""
    at = unused(docs, "_at")
    rows = located(docs, at)
    found = _grouped(rows, at)
    gone = keep(found.where(~F.col("kept")).select(F.col("locator").alias(at)), "exact-copies")
    discard(found)
    return rows.join(gone, at, "left_anti").select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
"""
