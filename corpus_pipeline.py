"""The corpus pipeline: reject toxic documents, drop exact and near copies, mix sources, pack sequences.

Every stage takes ``(spark, docs, folder)`` and returns a table that is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowguard.llm import exact_dedup, mixing, packing, simhash, toxicity
from rowguard.session import shared_folder

#: Scores, fits and packing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{place}/{k}-{name}"
        stage(spark, docs, folder).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
