"""Corpus pipeline over ``documents``: five stages, each over all its predecessor kept.

Quality classifier and quality rules drop what they reject, MinHash keeps one
document of each class of near-duplicates, suffix-array deduplication cuts
repeated passages out of the texts, and packing lays the token ids of what is
left into sequences. Rejected rows and cut text are not seen by later stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from agora.llm import minhash, quality_classifier, quality_rules, queries, suffix_dedup
from agora.session import ensure_checkpoint_dir


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    weights = quality_classifier.fit(docs, queries.table(spark, sf_dir, "labels"), ~queries.held_out_label())
    return quality_classifier.keep(docs, weights, queries.LEAST_SCORE)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    return minhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without 100-byte strings that start earlier in the corpus."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return queries.packed(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("minhash", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: The classifier and the outlier rules are fitted models: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
