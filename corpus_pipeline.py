"""A corpus pipeline of five stages: quality rules, near-dedup, secret redaction, source mixing, packing.

Every stage takes any columns, whatever their names, and passes them through; a column that it needs and that is missing
counts as null. Documents without words go in the first stage, as they fail the base rules. Null ids and repeated rows
are treated as the operators say. An empty table gives an empty one. All but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orrery.llm import common, mixing, neardup, packing, quality, secrets


def _small_batches(spark: SparkSession) -> None:
    """The stages run one after another in the same executors, whose JVMs don't give memory back; so their Python workers
    hold less at a time than where an operator runs alone. Results are the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: the base rules, or a perplexity out of their language's band."""
    _small_batches(spark)
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five words, a similarity of 0.8 or more."""
    _small_batches(spark)
    return neardup.drop_near_duplicates(docs, percent=80, width=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; every document stays."""
    _small_batches(spark)
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as their source's target asks."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its sequence and place; null texts are the end token alone."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=50_000, gather=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Tokenization and the models have no SQL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is a stored table that the next one reads."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
