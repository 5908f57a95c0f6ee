"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontaminate, languages, licenses, lm, mixing, neighbours, oracles, prefix_trie, quality, similar, simhash, spelling, toxicity,
    url_filter,
)
from .registry import ORACLES, QUERIES, query
from .shared import fold, held_out, table, written

__all__ = ["ORACLES", "QUERIES"]


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


@query("op2_nearest")
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5)))
    found = quality.score_quality(docs, rules, out="score").select("doc_id", held_out("doc_id", 5).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op4_source_mix")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_position", "mix_tokens")


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm.learn(docs.filter(~held_out("doc_id", 10)))
    return lm.score_texts(docs, model, counts).select("doc_id", held_out("doc_id", 10).alias("held_out"), "lm.*")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5)))
    found = toxicity.score_toxicity(docs, model, out="score").select("doc_id", held_out("doc_id", 5).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = languages.learn(docs.filter(~held_out("doc_id", 4, 2)), "text", "lang", "doc_id")
    return languages.identify_languages(docs.select("doc_id", "text"), model, out="found").select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected"
    )


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similarity_classes(table(spark, sf_dir, "documents")).drop("text_hash", "fp")


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score``: certainty that a licence is stated, halving the doubt with each finding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, out="found")
    hits = F.size("found.spans") + F.size("found.expressions")
    return found.select(
        "doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word", "found.base_labels",
        "found.labels", (1 - F.pow(F.lit(0.5), hits)).alias("score"), "found.permitted", "found.expressions",
    )


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and test item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out="hits")
    return found.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", F.col("h.item").alias("item_id"), "h.first_word", "h.words", "h.score", "h.question", "h.answer"
    )


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", oracles.PREFIX_TRIE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the conversations rebuilt as forks: up to 8 turns come from the conversation that starts their five."""
    turns = written(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")), "trie-turns")
    conv = F.col("conv_id")
    return prefix_trie.prefix_trie(*prefix_trie.forked(turns, conv - conv % 5, fold(conv, 9), 8)).drop("id")


@query("op13_spelling", oracles.SPELLING)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
