"""From raw documents to shards of token ids: quality rules, near-duplicates, benchmark decontamination, mixing, output.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of `documents`; the last returns one row a kept document copy with its place in the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import common, decontaminate, mixing, neardup, quality, tokenbin


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much."""
    return quality.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in shuffled shards."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; one row a document copy."""
    return tokenbin.materialise_tokens(docs)[0]


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]

ORACLE_SQL = None  # tokenisation and keyed draws are beyond SQL; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.save(docs, name.replace(" ", "-"))
    return docs
