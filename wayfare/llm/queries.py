"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import (
    alignment,
    decontaminate,
    hard_negatives,
    html_wrappers,
    maxent_lm,
    packing,
    passages,
    quality_lines,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
    url_templates,
)
from wayfare.llm.common import table
from wayfare.llm.tokens import vocabulary, word_bpe_path

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe_path(), capacity=2048, separator=0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), length=200)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seed=42, radius=2)


def op7_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.quality(table(spark, sf_dir, "documents"))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score_texts(table(spark, sf_dir, "documents"), modulus=7, held=2)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_corpus(table(spark, sf_dir, "documents"), word_bpe_path(), end_id=2)


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=4, held=2)
    return toxicity.score(docs, model, modulus=4, held=2, threshold=0.3)


def op11_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_fm_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(table(spark, sf_dir, "documents"), length=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_templates,
        op2_html_wrappers,
        op3_template_decontamination,
        op4_best_fit_packing,
        op5_suffix_dedup,
        op6_simhash,
        op7_quality_lines,
        op8_maxent_lm,
        op9_token_files,
        op10_toxic_segments,
        op11_fragment_alignment,
        op12_lemp_negatives,
        op13_fm_passages,
    )
}

# The others are no plain SQL: the method's verdicts, models, tokenizers and words of whole texts are tested against
# brute force instead.
ORACLES: dict[str, str] = {"op12_lemp_negatives": hard_negatives.MINE_SQL}
