"""Keyed questions from chunks of documents to shards of keys, and the answers back.

Operators that need corpus-wide facts about very many keys (phrases, words)
do not explode documents into one row per key. Documents are dealt into
chunks of a few megabytes; a chunk sends every shard one row with its sorted
distinct keys there, packed, and gets one row of answers in the same order.
Spark shuffles chunks and shards; a task holds one of them at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_count(documents: DataFrame, chunk_bytes: int) -> int:
    """Chunks of about ``chunk_bytes`` bytes of text for all documents."""
    total = documents.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0  # one number
    return max(1, math.ceil(total / chunk_bytes))


def chunked(documents: DataFrame, chunks: int) -> DataFrame:
    """``documents`` with a chunk number: by id, or by text where the id is null."""
    return documents.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))),
                                                F.lit(chunks)).cast("int"))


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """An integer array, as deltas if ascending, its bytes regrouped by significance and compressed."""
    raw = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<"))
    if ascending and len(raw):
        raw = np.concatenate([raw[:1], raw[1:] - raw[:-1]])
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T if len(raw) else np.zeros(0, np.uint8)
    data = np.ascontiguousarray(planes).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b"\0\0\0\0"


def unpack(blob: bytes, kind, ascending: bool = False) -> np.ndarray:
    n, size = int.from_bytes(blob[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    data = pa.decompress(blob[4:], n * size, codec="zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).reshape(-1).view(np.dtype(kind).newbyteorder("<"))
    return np.cumsum(values, dtype=kind) if ascending else values.astype(kind)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard number of mixed 64-bit keys, ascending in the key, so sorted keys lie shard by shard."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Ends of the shards' runs in sorted keys: shards + 1 positions."""
    return np.searchsorted(shard_of(sorted_keys, shards), np.arange(shards + 1))
