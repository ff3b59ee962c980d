"""The operators' queries. Importing this module registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm import (
    bayes_dedup, compression_quality, cover_tree, html_text, language_crf, minhash_forest, mixing, oracles, packing, ppm, quality_rules, source_divergence, token_counts, word_runs,
)
from crosspanel.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and line-first verdict of every document."""
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document."""
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), **packing_vocabulary())


def packing_vocabulary() -> dict:
    """Vocabulary of byte_bpe_50k.json, by the rank file of the same vocabulary."""
    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": {"<|endoftext|>": 50256}}


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, by the 32k piece model."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return minhash_forest.similar_documents(table(spark, sf_dir, "documents"))


def op7_rake_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and fate of every document, raked to source, language and topic."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return compression_quality.classify(docs, compression_quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_crf.identify(docs, language_crf.fit(docs))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every fiftieth vector among all others."""
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op11_bayes_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of every document."""
    return bayes_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, a tenth of which is made periodic first."""
    return word_runs.run_digests(word_runs.detect_runs(word_runs.with_planted_periods(table(spark, sf_dir, "documents"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every two sources of a language, and the terms that set each apart."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ppm_scores": op2_ppm_scores,
    "op3_html_text": op3_html_text,
    "op4_swap_packing": op4_swap_packing,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_forest": op6_minhash_forest,
    "op7_rake_mixing": op7_rake_mixing,
    "op8_compression_quality": op8_compression_quality,
    "op9_language_crf": op9_language_crf,
    "op10_cover_tree": op10_cover_tree,
    "op11_bayes_dedup": op11_bayes_dedup,
    "op12_word_runs": op12_word_runs,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.quality_rules_sql(),
    "op6_minhash_forest": oracles.SIMILAR_DOCUMENTS,
    "op10_cover_tree": oracles.TOP_K,
    "op11_bayes_dedup": oracles.NEAR_DUPLICATES,
    "op12_word_runs": oracles.WORD_RUNS,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
