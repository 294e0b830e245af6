"""A corpus pipeline of five stages, each calling one operator of quarryflow.llm.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept, and returns a DataFrame; `run` writes it as Parquet and reads it
back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.llm.common import store, table, texts
from quarryflow.llm.decontaminate import decontaminate
from quarryflow.llm.near_dedup import keep_one
from quarryflow.llm.packing import pack
from quarryflow.llm.pii import mask_pii
from quarryflow.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 by the quality classifier go.

    It learns from the labelled rows of docs whose crc32(doc_id) mod 4 is not 2.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, the one with the least doc_id.

    Wide SimHash fingerprints of five-word shingles propose groups; links are
    pairs that are 0.8 similar by exact count of their shingles.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is 0.8 or more similar to a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind; n_chars counts the masked text."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its bucket, batch and slot."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: The classifier and the fingerprints are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
