"""The corpus pipeline: raw documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.llm import mixing, packing, pii, simhash, toxicity
from gridtally.llm.common import checkpointed, table, word_count

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the machine learned from ``labels`` rejects."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), machine) < toxicity.THRESHOLD)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of its source wants; packing deals them out anew."""
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.mixed(sized, in_order=False).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("simhash", one_of_each),
    ("pii", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has no expression for the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``.

    What a stage returns is written before the next one reads it, so each stage is computed
    once however often the next looks at its documents.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for _, stage in stages:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
