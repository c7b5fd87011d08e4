"""Corpus pipeline: language ID, quality, near-duplicates, decontamination and mixing, one stage after the other.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns what it keeps as
documents; the last one also returns what the mix takes. Between stages the documents are written as Parquet and read
again, so a lost executor costs the tasks of one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import decontamination, language_id, mixing, quality, simhash
from windrow.llm.common import shared_folder, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays in doubt (posterior under one half)."""
    return language_id.keep(docs, language_id.train(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose posterior of being good is under one half."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mix takes, with size, source_size, target, copies and taken (copies x size)."""
    key = F.struct("doc_id", F.xxhash64("text", F.col("text").isNull()).alias("text"))  # ids may repeat or be null; not with one text
    found = mixing.mix(docs.withColumn("doc_id", key)).where("copies > 0").withColumnRenamed("doc_id", "_key").drop("source")
    return docs.withColumn("_own", key).join(found, F.col("_own") == F.col("_key")).drop("_own", "_key")


STAGES = [
    ("language_id", languages),
    ("quality", good),
    ("simhash_dedup", near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: No stage can be stated in SQL; tests hold the pipeline against the operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; stages hand over by Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
