"""Inputs that every text operator must take: nulls, empty and long texts, ties, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["chunk", "key", "rep", "words", "score", "kept", "n_words", "row", "shard", "mean", "label"]


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "the", "ing", "re", "ti", "on", "es", "sh", "ou", "wh", "ea", "ble"]
    words = ["".join(rng.choices(syllables, k=rng.choice([1, 2, 2, 3]))) for _ in range(n)]
    return ". ".join(" ".join(words[i:i + 9]) for i in range(0, n, 9)).capitalize() + "."


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    base, shared = prose(rng, 80), prose(rng, 40)
    edited = base.replace(" the", " teh", 1)
    return [
        (1, base, "en", "a", 1), (2, base, "en", "a", 2), (3, edited, "en", "b", None),
        (4, None, "en", "a", 0), (5, "", None, "a", 0), (6, " \n\t ", "en", None, 3),
        (7, "one", "en", "a", 3), (8, shared + "\n" + prose(rng, 60), "fr", "b", 9),
        (9, prose(rng, 60) + "\n" + shared, "fr", "b", 9), (10, "x" * 5000, "en", "a", 5000),
        (11, "é🙂 " * 300, "de", "a", 900), (12, prose(rng, 3000), "en", "b", 1),
        (12, "again the same id", "en", "b", 1), (13, base, "en", "a", 2), (13, base, "en", "a", 2),
        (None, prose(rng, 70), "en", "a", 1), (None, base, None, None, None),
        (14, "### $$$ <|endoftext|> <s> don't STOP", "en", "a", 1),
    ]


def odd(spark: SparkSession) -> DataFrame:
    """The odd rows over two partitions, with further columns whose names the operators use inside."""
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(2)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
