"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next one.

Defined cases, in the order of the stages: null, empty and very long texts are scored like any other, and stay or go by their score; texts
without words and rows without an id are no near copies of anything; rows that share an id are kept or dropped together, equal rows too; rows without an id
are searched for benchmark items like others; null texts stay null when personal data are replaced; documents without words are in no mix.
Other columns pass through to the fourth stage; a table without rows gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import decontam, jaccard, mixing, pii, quality
from trailmark.llm.common import shared_dir, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents at hand."""
    return quality.keep(docs, quality.learn(docs, quality.training_labels(table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised ones included."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by placeholders."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; documents that it doesn't take are left out."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The classifier is trained, so SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
