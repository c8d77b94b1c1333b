"""The corpus pipeline: language ID, line dedup, Jaccard dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a table, written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import decontaminate, jaccard, langid, linededup, mixing
from framewright.llm.common import release, shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows: those without letters go, and those whose
    score for the predicted language is under 0.3."""
    return langid.reject(docs)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share; the first holder keeps a line."""
    return linededup.clean(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return jaccard.clean(docs)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language-id", identify_language),
    ("line-dedup", remove_boilerplate_lines),
    ("jaccard-join", remove_near_duplicates),
    ("decontamination", remove_benchmark_text),
    ("mixing", mix_sources),
]

#: Trained models and hashed joins have no SQL form; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if k:  # the stage before is read no more
            release(spark, docs)
        docs = spark.read.parquet(path)
    return docs
