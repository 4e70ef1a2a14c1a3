"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from phonoframe.llm import decontam, mixing, quality, simhash, tokenout
from phonoframe.llm.common import shared_dir, table
from phonoframe.llm.queries import tokenizer_path

TARGETS = {0: 0.95, 1: 0.05}  # share of tokens by labels.toxic
ORACLE_SQL = None  # the classifiers and the fingerprints can't be expressed in SQL


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the line classifier rates below 0.7 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles have a similarity of 0.8 or more are a class: of each, the smallest doc_id stays."""
    return simhash.drop_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold 0.8 of a benchmark item's five-word shingles go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents repeat, or go, so that the domains' token totals match the targets."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token files in the shared folder; the result is what reading them back gives."""
    return tokenout.token_files(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("token-ID output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
