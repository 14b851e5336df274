"""The stages that turn documents into a training mix, each one written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordspace.llm import decontaminate, exact_dedup, mixing, near_dedup, quality, queries
from wordspace.sources.scratch import materialize


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier of the labels accepts."""
    labels = queries.table(spark, sf_dir, "labels")
    return quality.keep(docs, quality.train(docs, labels, learn=queries.remainder("doc_id", 5) != 0))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that quote no benchmark item."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by target weights, with how often it holds each."""
    return mixing.mix(docs, queries.tree(docs))


STAGES = [
    ("quality", accept_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: A fitted classifier and sampled signatures have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read back."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
