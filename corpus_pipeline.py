"""From documents to token files: five stages, each reading what the one before it kept.

Every stage takes and returns the columns of ``documents``; the last returns the digests of the
token files it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import dart_minhash, decontamination, mixing, token_files, toxicity
from tallyspark.llm.queries import CATEGORIES, MIX_WEIGHTS, levels, table, toxic_labels, vocabulary
from tallyspark.plans.staging import stage

#: The mixture has as many tokens as the documents that reach it, and repeats a leaf at most once.
MIX_SHARE, MIX_EPOCHS = 1.0, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    scored = toxicity.toxic_scores(docs, toxic_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return scored.filter("NOT rejected").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return dart_minhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights; one that is used in two epochs is there twice."""
    return mixing.mix(docs, levels(docs), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written token files."""
    return token_files.token_digests(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: SQL cannot express the trained chain, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
