"""Texts as numbers: each chunk of comments is read once and kept as places in its own list of words.

A task cuts its comments into chunks of a bounded number of words. A chunk keeps its distinct words in the order of
their crc32, every word as a place in that list, and the comments' keys. What a chunk has to know of its words (their
number in the whole vocabulary, their score) it asks of shards of the vocabulary, one row per chunk and shard, and
gets back in the same order; a range of crc32 makes a shard, so a chunk's questions to it are a run of its list. A
row per word of a comment is never shuffled.
"""

from __future__ import annotations

import gc
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.functions.text import is_blank, word_tokens
from agora.llm.common import bounded_batches, prepare, release
from agora.llm.exchange import pack, unpack
from agora.operators.kmeans import stored

#: Words of a chunk, distinct words of all chunks in a shard, and words whose pairs make a bucket, about.
CHUNK, SHARD, BUCKET = 1 << 21, 1 << 19, 1 << 21
SHARDS = 8  # at least, so that a small vocabulary has several tasks
MIX = np.uint64(0x9E3779B97F4A7C15)


def kept(df: DataFrame, at_once: bool = True) -> DataFrame:
    """``df``, written once. The driver then looks which shuffles nothing refers to any more, so that their files go
    now and do not add up: ``at_once`` those of this write too (Spark holds the last job's until the next), or with
    the next write."""
    spark, rows = df.sparkSession, stored(df)
    if at_once:
        spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return rows


def joined(words: list[str]) -> bytes:
    """Words (which hold no line breaks), compressed."""
    raw = "\n".join(words).encode()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def parted(blob: bytes) -> list[str]:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], n, codec="zstd", asbytes=True).decode().split("\n") if n else []


def released(make, *args) -> pa.Table:
    """What ``make`` gives, after its own memory has gone back to the system."""
    made = make(*args)
    release()
    return made


def shard_ends(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ends of the shards' runs in ascending crc32 values: shards + 1 positions."""
    return np.searchsorted(hashes.astype(np.uint64) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))


class _Numbered(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _chunks(batches, size: int, schema: pa.Schema):
    """One row per chunk of the batches' (key, blank, words)."""
    task, made = TaskContext.get().partitionId(), 0
    ids, codes, lengths, kept, n = _Numbered(), [], [], [], 0

    def flush() -> pa.RecordBatch:
        words = list(ids)
        hashes = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words))
        order = np.lexsort((np.arange(len(words)), hashes))
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays([b.column(k) for b in kept]))
                 for k in ("key", "blank")]
        return pa.RecordBatch.from_arrays([
            pa.array([task << 32 | made], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([n], pa.int64()),
            pa.array([joined([words[i] for i in order])], pa.binary()), pa.array([pack(hashes[order], True)], pa.binary()),
            pa.array([pack(place[np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.int64)])], pa.binary()),
            pa.array([pack(np.array(lengths, np.uint32))], pa.binary()), *(x.cast(schema.field(k).type) for k, x in zip(("key", "blank"), lists))],
            schema=schema)

    for batch in batches:
        start = 0
        for i, text in enumerate(batch.column("words").to_pylist()):
            words = text.split(" ") if text else []
            codes.append(np.fromiter(map(ids.__getitem__, words), np.uint32, len(words)))
            lengths.append(len(words))
            n += len(words)
            if n + 8 * len(lengths) >= size:
                kept.append(batch.slice(start, i + 1 - start).select(["key", "blank"]))
                yield flush()
                start, made = i + 1, made + 1
                ids, codes, lengths, kept, n = _Numbered(), [], [], [], 0
        if start < batch.num_rows:
            kept.append(batch.slice(start).select(["key", "blank"]))
    if lengths:
        yield flush()


def _number(asks: pa.Table, shards: int, schema: pa.Schema) -> pa.Table:
    """A shard's words, in order, and for each chunk their numbers: shard + shards * place."""
    shard = asks.column("shard")[0].as_py()
    lists = [parted(b) for b in asks.column("words").to_pylist()]
    words = sorted(set().union(*lists))
    number = {w: shard + shards * i for i, w in enumerate(words)}
    rows = [(c, shard, pack(np.fromiter(map(number.__getitem__, ws), np.uint32, len(ws))))
            for c, ws in zip(asks.column("chunk").to_pylist(), lists)]
    rows.append((None, shard, joined(words)))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _in_order(answers: pa.Table, column: str, kind) -> np.ndarray:
    order = np.argsort(answers.column("shard").to_numpy())
    blobs = answers.column(column)
    return np.concatenate([*(unpack(blobs[int(i)].as_py(), kind) for i in order), np.zeros(0, kind)])


def _pair_counts(chunk: pa.Table, answers: pa.Table, window: int, buckets: int, schema: pa.Schema) -> pa.Table:
    """A chunk's pairs of different words within ``window`` words, as sorted keys with their counts, by bucket."""
    numbers = _in_order(answers, "answer", np.uint32).astype(np.int64)
    keys = []
    for i in range(chunk.num_rows):  # one
        codes, lengths = unpack(chunk.column("codes")[i].as_py(), np.uint32), unpack(chunk.column("lengths")[i].as_py(), np.uint32)
        line = np.full(len(codes) + window * len(lengths), -1, np.int64)  # comments stand ``window`` places apart
        line[np.arange(len(codes)) + window * np.repeat(np.arange(len(lengths)), lengths)] = numbers[codes]
        for d in range(1, window + 1):
            low, high = np.minimum(line[:-d], line[d:]), np.maximum(line[:-d], line[d:])
            some = (low >= 0) & (low != high)
            keys.append((low[some] << 32 | high[some]).astype(np.uint64))
    keys = np.sort(np.concatenate([*keys, np.zeros(0, np.uint64)]))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    counts, keys = np.diff(np.append(starts, len(keys))).astype(np.uint32), keys[starts]
    bucket = ((keys * MIX >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(k, pack(keys[order[i:j]], True), pack(counts[order[i:j]])) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)


def _pair_sums(parts: pa.Table, least: int, schema: pa.Schema) -> pa.Table:
    """(a, b, n) of a bucket's pairs that all chunks together have ``least`` times or more."""
    keys = np.concatenate([unpack(x.as_py(), np.uint64, True) for x in parts.column("keys")])
    counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in parts.column("counts")]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    sums = np.add.reduceat(counts[order], starts) if len(keys) else counts
    keys, sums = keys[starts][sums >= least], sums[sums >= least]
    return pa.Table.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int64)),
                                 pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(sums)], schema=schema)


def _shard_scores(asks: pa.Table, learned: pa.Table, schema: pa.Schema) -> pa.Table:
    """For every chunk the scores of its words in this shard; 0 for a word that has none."""
    score = dict(zip(learned.column("word").to_pylist(), learned.column("score").to_pylist()))
    rows = []
    for chunk, shard, blob in zip(*(asks.column(k).to_pylist() for k in ("chunk", "shard", "words"))):
        words = parted(blob)
        rows.append((chunk, shard, pack(np.fromiter((score.get(w, 0.0) for w in words), np.float64, len(words)))))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)


def _comment_sums(chunk: pa.Table, answers: pa.Table, schema: pa.Schema) -> pa.Table:
    """(key, blank, total, size) of a chunk's comments: sums of their words' scores and of their sizes."""
    scores, parts = _in_order(answers, "answer", np.float64), []
    for i in range(chunk.num_rows):  # one
        codes, lengths = unpack(chunk.column("codes")[i].as_py(), np.uint32), unpack(chunk.column("lengths")[i].as_py(), np.uint32)
        by_word, some = scores[codes], lengths > 0
        starts = (np.cumsum(lengths.astype(np.int64)) - lengths)[some]
        total, size = np.zeros(len(lengths)), np.zeros(len(lengths))
        if len(starts):
            total[some], size[some] = np.add.reduceat(by_word, starts), np.add.reduceat(np.abs(by_word), starts)
        parts.append(pa.Table.from_arrays([chunk.column("key")[i].values, chunk.column("blank")[i].values,
                                           pa.array(total), pa.array(size)], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


class Texts:
    """``comments`` as chunks of numbered words, written once."""

    def __init__(self, comments: DataFrame, key: str | None = None, body: str = "body") -> None:
        from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

        self.spark, self.arrow = comments.sparkSession, to_arrow_schema
        prepare(self.spark)
        bounded_batches(self.spark)
        keys = F.col(key) if key else F.lit(None).cast("long")
        read = comments.select(keys.alias("key"), is_blank(F.col(body)).alias("blank"),
                               F.array_join(word_tokens(F.col(body)), " ").alias("words"))
        self.key = read.schema["key"].dataType
        schema = T.StructType([*(T.StructField(k, T.LongType()) for k in ("chunk", "n_words", "n")),
                               *(T.StructField(k, T.BinaryType()) for k in ("words", "hashes", "codes", "lengths")),
                               T.StructField("key", T.ArrayType(self.key)), T.StructField("blank", T.ArrayType(T.BooleanType()))])
        arrow = to_arrow_schema(schema)

        def run(batches, size=CHUNK):
            yield from _chunks(batches, size, arrow)
            release()
        self.chunks = kept(read.mapInArrow(run, schema))
        words, self.n = self.chunks.agg(F.sum("n_words"), F.sum("n")).first()
        self.shards, self._numbers = max(SHARDS, math.ceil((words or 0) / SHARD)), None

    def asks(self) -> DataFrame:
        """(shard, chunk, words): a chunk's words in a shard."""
        shards, schema = self.shards, T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.LongType()),
                                                    T.StructField("words", T.BinaryType())])
        arrow = self.arrow(schema)

        def run(batches):
            for batch in batches:
                for chunk, blob, hashes in zip(*(batch.column(k).to_pylist() for k in ("chunk", "words", "hashes"))):
                    words, ends = parted(blob), shard_ends(unpack(hashes, np.uint32, True), shards)
                    rows = [(k, chunk, joined(words[i:j])) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, arrow)],
                                                     schema=arrow)
        return self.chunks.select("chunk", "words", "hashes").mapInArrow(run, schema)

    @property
    def answers(self) -> T.StructType:
        return T.StructType([T.StructField("chunk", T.LongType()), T.StructField("shard", T.IntegerType()),
                             T.StructField("answer", T.BinaryType())])

    def numbers(self) -> DataFrame:
        """(chunk, shard, answer): the numbers of a chunk's words in a shard; without a chunk, the shard's words."""
        if self._numbers is None:
            shards, arrow = self.shards, self.arrow(self.answers)
            self._numbers = kept(self.asks().groupBy("shard").applyInArrow(lambda asks: released(_number, asks, shards, arrow), self.answers))
        return self._numbers

    def vocabulary(self) -> DataFrame:
        """(id, word) of all distinct words."""
        shards, schema = self.shards, T.StructType([T.StructField("id", T.LongType()), T.StructField("word", T.StringType())])
        arrow = self.arrow(schema)

        def run(batches):
            for batch in batches:
                for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("answer").to_pylist()):
                    words = parted(blob)
                    yield pa.RecordBatch.from_arrays([pa.array(shard + shards * np.arange(len(words), dtype=np.int64)),
                                                      pa.array(words, arrow.field("word").type)], schema=arrow)
        return self.numbers().where(F.col("chunk").isNull()).mapInArrow(run, schema)

    def pairs(self, window: int, least: int) -> DataFrame:
        """(a, b, n) with a < b, by number: how often two different words stand within ``window`` words of each other."""
        buckets = max(1, math.ceil((self.n or 0) / BUCKET))
        parts = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(k, T.BinaryType()) for k in ("keys", "counts"))])
        schema = T.StructType([T.StructField(k, T.LongType()) for k in "abn"])
        arrow, found = self.arrow(parts), self.arrow(schema)
        numbers = self.numbers().where(F.col("chunk").isNotNull())
        counted = (self.chunks.select("chunk", "codes", "lengths").groupBy("chunk").cogroup(numbers.groupBy("chunk"))
                   .applyInArrow(lambda c, a: released(_pair_counts, c, a, window, buckets, arrow), parts))
        return counted.groupBy("bucket").applyInArrow(lambda p: released(_pair_sums, p, least, found), schema)

    def sums(self, learned: DataFrame) -> DataFrame:
        """(key, blank, total, size) of every comment, from the scores of ``learned`` (word, score)."""
        scored = learned.select(F.shiftright(F.crc32(F.col("word").cast("binary")) * F.lit(self.shards), 32).cast("int").alias("shard"),
                                "word", F.col("score").cast("double").alias("score"))
        schema = T.StructType([T.StructField("key", self.key), T.StructField("blank", T.BooleanType()),
                               T.StructField("total", T.DoubleType()), T.StructField("size", T.DoubleType())])
        arrow, found = self.arrow(self.answers), self.arrow(schema)
        answers = (self.asks().groupBy("shard").cogroup(scored.groupBy("shard"))
                   .applyInArrow(lambda asks, s: released(_shard_scores, asks, s, arrow), self.answers))
        return (self.chunks.select("chunk", "codes", "lengths", "key", "blank").groupBy("chunk").cogroup(answers.groupBy("chunk"))
                .applyInArrow(lambda c, a: released(_comment_sums, c, a, found), schema))
