"""The corpus pipeline: each stage gets what the one before it kept; all but the last return the columns of documents.

Rows are told apart by their place in the files, so null and repeated doc_ids are rows like others, and each stage decides on
every row. Null and empty texts aren't toxic; one of them stays after exact deduplication, hits no benchmark and is packed as
its final id. An empty table is an empty result. What a stage has written goes when the next one has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubewind.llm import decontaminate, exact_dedup, jaccard, pack, toxicity
from cubewind.llm.tables import discard, keep

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", jaccard.stage),
    ("decontaminate", decontaminate.stage),
    ("pack", pack.stage),
]

#: Scores of a trained grammar and packing can't be expressed in SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
