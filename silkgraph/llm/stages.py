"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of their input; classifiers learn from labelled documents that are
still there, and only from the folds that the single queries learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, mixing, quality, similar, toxicity
from .shared import held_out, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    rules = quality.learn(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5)))
    own = docs.select(F.struct("*").alias("own"), F.col("text").alias("text"))
    return quality.score_quality(own, rules, out="score").filter(F.col("score") >= 0.3).select("own.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models do not reject."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5)))
    return docs.filter(toxicity.toxicity(F.col("text"), model, spark) < 0.5)


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest key; a repeated row stays once."""
    return similar.one_of_each(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontaminate.contamination(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.filter(F.size(found) == 0)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources, with epoch, block and position."""
    return mixing.mixture(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-duplicates", similar_stage),
    ("decontamination", contamination_stage),
    ("mixing", mixing_stage),
]
