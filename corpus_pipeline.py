"""From raw documents to packed sequences, in five stages; each works on all that the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import decontaminate, packing, quality_lines, simhash, substring_dedup
from wayfare.llm.common import table
from wayfare.llm.tokens import word_bpe_path
from wayfare.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules or the base rules reject go."""
    return quality_lines.kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints stays: three words, two bits, as the operator's own query has it."""
    return simhash.one_of_each(docs, shingle=3, seed=42, radius=2)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that also stand elsewhere are cut out of the texts."""
    return substring_dedup.cleaned_texts(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, word_bpe_path(), capacity=2048, separator=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# The tokenizer, the fingerprints' components and the line rules are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/wayfare/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
