"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal.

Features. A text is cut at spaces and line feeds, a part into words and runs
of punctuation; a word counts as itself and as its shape (letter case, digit,
or the first two marks of a run), so that unseen words say something too.
One- and two-word sequences of both are hashed into 2**bits columns, a pair of
equal words into one column of its own; a column's value is log(1 + count),
and a text's vector has length 1. Counts come from all of the text.

Fitting. ``labels`` rows that the caller admits are put in the order of a hash
of their id, and the first ``max_rows`` (the documented bound of the training
sample) are joined to the texts by a broadcast of those ids. Each of
``shards`` tasks passes over its share ``epochs`` times, updating per
coordinate (FTRL-proximal), with both labels weighing the same in sum; the
weights are the shards' mean. Scoring is a
sparse dot product in one scan of the documents.

Null or empty text: the bias alone decides. Null labels are left out; several
labels of one id count by the smallest; without labels every score is 0.5.
Repeated rows give one row each; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from agora.llm.common import WordCache, id_text, map_batches, map_rows, prepare, release, strings

SCHEMA = "doc_id long, score double"
_WORD = re.compile(r"\w+|[^\w\s]+")
_REPEAT = np.uint32(zlib.crc32(b"\x00repeat"))


def shape(word: str) -> str:
    if word.isdigit():
        return "\x00digit"
    if not (word[0].isalnum() or word[0] == "_"):
        return "\x00" + word[:2]
    if word.islower():
        return "\x00lower"
    if word.isupper():
        return "\x00upper" if len(word) > 1 else "\x00letter"
    return "\x00title" if word[1:].islower() else "\x00mixed"


def part_hashes(part: str) -> bytes:
    """Of each word of a part: the hash of the word and of its shape."""
    return b"".join(zlib.crc32(x.encode()).to_bytes(4, "little")
                    for w in _WORD.findall(part) for x in (w, shape(w)))


def part_cache() -> WordCache:
    """One a task: a worker that goes on with other work does not keep it."""
    return WordCache(part_hashes, 200_000)


def features(text: str, bits: int, parts: WordCache | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text; column 0 is the bias."""
    parts = part_cache() if parts is None else parts
    raw = b"".join(map(parts.__getitem__, text.replace("\n", " ").split(" ")))
    words = np.frombuffer(raw, "<u4").reshape(-1, 2)
    if not len(words):
        return np.zeros(1, np.int64), np.ones(1)
    pairs = (words[:-1] * np.uint32(0x9E3779B1)) ^ (words[1:] * np.uint32(0x85EBCA77) + np.uint32(1))
    pairs[words[:-1, 0] == words[1:, 0], 0] = _REPEAT
    mixed = np.concatenate([words.ravel(), pairs.ravel()]) * np.uint32(0xC2B2AE35)
    columns, counts = np.unique(mixed >> np.uint32(32 - bits), return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt(values @ values)
    return np.concatenate([[0], columns.astype(np.int64) + 1]), np.concatenate([[1.0], values])


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 5
    max_rows: int = 16_000
    shards: int = 4


def weights_at(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
    return np.where(np.abs(z) <= s.l1, 0.0, w)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Columns and weights that are not 0, after ``epochs`` passes over the rows in their order."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    positive = sum(y for _, _, y in rows)
    weight = [len(rows) / (2 * max(1, len(rows) - positive)), len(rows) / (2 * max(1, positive))]
    for _ in range(s.epochs):
        for columns, values, label in rows:
            zi, ni = z[columns], n[columns]
            w = weights_at(zi, ni, s)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35.0, 35.0)))
            g = weight[label] * (p - label) * values
            after = ni + g * g
            z[columns] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / s.alpha * w
            n[columns] = after
    w = weights_at(z, n, s)
    used = np.flatnonzero(w)
    return used, w[used]


def fit(documents: DataFrame, labels: DataFrame, admitted: Column, s: Settings = Settings(),
        label_col: str = "quality") -> np.ndarray:
    """Weights from the labelled documents that ``admitted`` (a condition on doc_id) lets in."""
    prepare(documents.sparkSession)
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & admitted)
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows))
    rows = (id_text(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("text", "label", F.xxhash64("doc_id", F.lit(1)).alias("at")))

    def featurise(batches):
        parts = part_cache()
        for batch in batches:
            found = [features(t, s.bits, parts) for t in strings(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("at"),
                 pa.array([c.astype("<u4").tobytes() for c, _ in found], pa.binary()),
                 pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())],
                names=["label", "at", "columns", "vals"])
        del parts
        release()

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("at", "ascending"), ("label", "ascending")])
        rows = [(np.frombuffer(c, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64), y)
                for c, v, y in zip(group["columns"].to_pylist(), group["vals"].to_pylist(),
                                   group["label"].to_pylist())]
        used, w = ftrl(rows, s)
        return pa.table({"columns": pa.array([used.astype("<u4").tobytes()], pa.binary()),
                         "vals": pa.array([w.astype("<f8").tobytes()], pa.binary()),
                         "n": pa.array([len(rows)], pa.int64())})

    shards = (rows.mapInArrow(featurise, "label int, at long, columns binary, vals binary")
              .groupBy(F.pmod("at", F.lit(s.shards)).alias("shard"))
              .applyInArrow(train, "columns binary, vals binary, n long")).collect()  # one row a shard
    total, weights = sum(r["n"] for r in shards), np.zeros((1 << s.bits) + 1)
    for r in shards:
        weights[np.frombuffer(r["columns"], "<u4")] += np.frombuffer(r["vals"], "<f8") * (r["n"] / total)
    return weights.astype(np.float32)


def score(documents: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; ``weights`` has a fixed size, 2**bits + 1."""
    model = documents.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def make():
        w, parts = model.value, part_cache()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(strings(batch.column("text")), w, bits, parts), pa.float64())],
                names=["doc_id", "score"])
        return run
    return map_batches(id_text(documents, id_col, text_col), make, SCHEMA)


def scores(texts: list[str], weights: np.ndarray, bits: int, parts: WordCache | None = None) -> np.ndarray:
    parts = part_cache() if parts is None else parts
    sums = [float(weights[c] @ v) for c, v in (features(t, bits, parts) for t in texts)]
    return 1.0 / (1.0 + np.exp(-np.clip(np.array(sums, float), -35.0, 35.0)))


def keep(documents: DataFrame, weights: np.ndarray, least: float) -> DataFrame:
    """The rows of ``documents``, all columns, whose text scores ``least`` or more."""
    model = documents.sparkSession.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    def make():
        w, parts = model.value, part_cache()

        def run(texts: list[str]) -> list[pa.Array]:
            return [pa.array(scores(texts, w, bits, parts), pa.float64())]
        return run
    scored = map_rows(documents, make, [StructField("score", DoubleType())])
    return scored.where(F.col("score") >= least).select("row.*")
