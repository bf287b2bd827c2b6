"""Spelling variants: near words by a bit-sliced position index, forms and their roots.

Words. Runs of letters of all whole texts, A-Z lower-cased, are counted; now
and then a run loses one letter by a hash of document and run, as the input
contract asks. Runs are counted per document and per task before they are
shuffled, so a frequent word costs a row a task.

Near words differ by one inserted, deleted or replaced code point. Such a pair
of shorter length c shares the first c // 2 code points or the last
c - c // 2, so every word is dealt to four groups (as the shorter and as the
longer word, by prefix and by suffix); a pair that shares both counts in the
prefix's group. Within a task whole groups of one c make windows. A window's
words are the columns of bitsets, one per (position, letter); for all query
words at once the recurrences keep the columns that match so far without an
error (zero), with a replaced letter, and with an inserted one, the latter
against the bitset of the next position. Groups with more than ``block`` words
are split into pairs of blocks. Tasks return one row per word: how many near
words it has and the best of them, never pairs.

A form is followed to the last by pointer jumping: a form occurs ``ratio``
times as often as its word, so chains are short and have no cycles.

A null text has no words; a null id counts as an empty one in the hash. Every
row counts, repeated ones too; ties of the best near word go to the smallest in
code-point order. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import prepare, with_blocks

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {u: u + 32 for u in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Settings:
    least_length: int = 6
    least_count: int = 5
    ratio: int = 5
    drop_every: int = 199   # a run loses a letter if this divides its hash
    block: int = 2048       # words of a group compared at once
    part: int = 16384       # rows of a task's group
    held: int = 300_000     # distinct words a task counts before it passes them on


def runs(text: str) -> Iterator[str] | list[str]:
    """The letter runs of a text; very long texts are not held as a list."""
    return RUN.findall(text) if len(text) < 1 << 22 else (m.group() for m in RUN.finditer(text))


def words_of(doc_id: int | None, text: str, s: Settings) -> Iterator[tuple[str, int]]:
    """(word, count) of one document; a word may come twice."""
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(runs(text)).items():
        if len(run) < s.least_length:
            continue
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        h = zlib.crc32(word.encode(), base)
        if h % s.drop_every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < s.least_length:
                continue
        yield word, n


def vocabulary(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(word, n) of every word with ``least_length`` code points and ``least_count`` occurrences."""
    prepare(docs.sparkSession)

    def count(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()),
                                               pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                for word, n in words_of(doc.as_py(), text.as_py() or "", s):
                    seen[word] += n
                if len(seen) > s.held:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= s.least_count)


class Window:
    """A bit-sliced position index over words of ``short`` or ``short + 1`` code points."""

    def __init__(self, words: list[str], short: int):
        self.n, self.short = len(words), short
        self.wide = -(-self.n // 64) * 64
        size = np.array([len(w) for w in words])
        self.codes = np.zeros((self.n, short + 2), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.codes[np.arange(short + 2) < size[:, None]] = flat
        self.letters, dense = np.unique(self.codes, return_inverse=True)
        self.dense = dense.reshape(self.codes.shape)
        self.shorter, self.longer = self.bits((size == short)[None])[0], self.bits((size == short + 1)[None])[0]
        self.queries = np.flatnonzero(size == short)

    def bits(self, rows: np.ndarray) -> np.ndarray:
        """Boolean rows over the words as bitsets of 64-bit numbers."""
        wide = np.zeros((len(rows), self.wide), bool)
        wide[:, :self.n] = rows
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def members(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the set bits."""
        return np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :self.n])

    def slice(self, at: int) -> np.ndarray:
        """The bitsets of all letters at a position."""
        return self.bits(self.dense[:, at][None] == np.arange(len(self.letters))[:, None])

    def near(self, queries: np.ndarray, among: np.ndarray):
        """Pairs (query, word) at one replaced letter, and those at one inserted one; ``among``: words compared, as rows of booleans."""
        zero = self.bits(among)
        replaced, inserted = np.zeros_like(zero), np.zeros_like(zero)
        here = self.slice(0)
        for i in range(self.short):
            letter, ahead = self.dense[queries, i], self.slice(i + 1)
            inserted = (inserted | zero) & ahead[letter]
            match = here[letter]
            replaced = (replaced & match) | (zero & ~match)
            zero &= match
            here = ahead
        for found in (replaced & self.shorter, (inserted | zero) & self.longer):
            a, b = self.members(np.ascontiguousarray(found))
            yield queries[a], b


def _windows(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, s: Settings) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of one c, of ``block`` rows and some megabytes of codes at most where there are several."""
    x = y = None
    for start, end in zip(starts, ends):
        if y is not None and (c[start] != c[x] or end - x > s.block or (end - x) * (int(c[x]) + 2) > 1 << 22):
            yield x, y
            x = None
        x, y = start if x is None else x, end
    if y is not None:
        yield x, y


def compare(cell: pa.Table, s: Settings) -> pa.Table:
    """Per row with near words: (word, n_near, best_n, best) among its group's words."""
    keys = ("c", "prefix", "key", "lo", "hi")
    cell = cell.sort_by([(k, "ascending") for k in (*keys, "word")]).combine_chunks()
    c, prefix, lo, hi, block, n = (cell[k].to_numpy(zero_copy_only=False) for k in ("c", "prefix", "lo", "hi", "block", "n"))
    key, words = cell["key"].to_pylist(), cell["word"].to_pylist()
    same = np.ones(max(0, len(c) - 1), bool)
    for a in (c, prefix, lo, hi, np.array(key, object)):
        same &= a[1:] == a[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    ends = np.concatenate([starts[1:], [len(c)]])
    several = ends - starts > 1
    out: list[tuple] = []
    for x, y in _windows(c, starts[several], ends[several], s):
        rows = np.arange(x, y)
        whole = Window(words[x:y], int(c[x]))
        order = np.array(sorted(range(y - x), key=lambda i: (-n[x + i], words[x + i])))
        rank = np.empty(y - x, np.int64)
        rank[order] = np.arange(y - x)
        count, best = np.zeros(y - x, np.int64), np.full(y - x, y - x)
        half = whole.short // 2
        for at in range(0, len(whole.queries), 512):
            q = whole.queries[at:at + 512]
            among = (group[rows[q]][:, None] == group[rows]) & (
                (lo[rows] == hi[rows]) | (block[rows[q]][:, None] != block[rows]))
            for number, (a, b) in enumerate(whole.near(q, among)):
                if number and len(a):
                    keep = prefix[rows[a]] | (whole.codes[a, :half] != whole.codes[b, :half]).any(1)
                    a, b = a[keep], b[keep]
                np.add.at(count, a, 1)
                np.minimum.at(best, a, rank[b])
                if number:
                    np.add.at(count, b, 1)
                    np.minimum.at(best, b, rank[a])
        for i in np.flatnonzero(count):
            j = order[best[i]]
            out.append((words[x + i], count[i], n[x + j], words[x + j]))
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.table({"word": pa.array(columns[0], pa.string()), "n_near": pa.array(columns[1], pa.int64()),
                     "best_n": pa.array(columns[2], pa.int64()), "best": pa.array(columns[3], pa.string())})


def near_words(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n) that has a near one."""
    length, word = F.char_length("word"), F.col("word")
    keys = []
    for c in (length, length - 1):
        half = F.floor(c / 2).cast("int")
        keys += [F.struct(c.alias("c"), F.lit(True).alias("prefix"), F.substr(word, F.lit(1), half).alias("key")),
                 F.struct(c.alias("c"), F.lit(False).alias("prefix"), F.right(word, c - half).alias("key"))]
    dealt = (words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*")
             .where(F.col("c") >= s.least_length))
    blocks = with_blocks(dealt, ["c", "prefix", "key"], s.block)
    rows = blocks.agg(F.sum("blocks")).first()[0] or 0  # one number
    placed = (blocks.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")))
    parts = max(12, math.ceil(rows / s.part))
    part = F.pmod(F.xxhash64("c", "prefix", "key", "lo", "hi"), F.lit(parts))
    found = (placed.select("word", "n", "c", "prefix", "key", "block", "lo", "hi", part.alias("part"))
             .groupBy("part").applyInArrow(lambda t: compare(t, s), "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last of the forms that follow one another, without cycles."""
    now = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = now.join(ahead, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")).checkpoint()
        if jumped.where("moved").isEmpty():
            return now
        now = jumped.drop("moved")


def variants(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = vocabulary(docs, s, id_col, text_col).checkpoint()
    near = near_words(words, s)
    has = F.col("best_n") >= s.ratio * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")).checkpoint()
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
