"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warehaul.llm import stages
from warehaul.session import materialised

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None

STAGES: list[tuple[str, Stage]] = stages.STAGES


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialised(docs, name)
    return docs
