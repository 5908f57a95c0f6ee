"""Corpus pipeline: quality, toxicity, near duplicates, decontamination and mixing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silkgraph.llm import stages
from silkgraph.llm.shared import table, written

STAGES = stages.STAGES
#: The classifiers and the permutation of the mix have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each result is written as Parquet and read again as the next input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
