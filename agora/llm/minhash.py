"""Near-duplicate documents: improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Shingles are runs of ``width`` lower-cased words (a shorter text is one
shingle). A shingle's weight in a text is its count times an inverse document
frequency scaled to between 1 and 2, 1 + log((N+1) / (df+1)) / log(N+1): rare
shingles weigh more, and no single one outweighs a text. Document frequencies
come from all documents through a count sketch of a fixed size (each task adds
up its own, segments are summed in a shuffle); the sketch's mean load is taken
off an estimate, and a weight depends on the shingle alone, so similarities
are exact for these weights.

``bands`` x ``rows`` ICWS samples make a signature; two texts agree in a
sample with the chance of their weighted Jaccard similarity. Texts that agree
in a whole band are candidates. Texts of the same words are one text from the
start. In every band bucket the smallest id is the leader: candidates are
(leader, member), one row per member and band at most, tested by the weighted
Jaccard similarity of the whole texts and joined to components. What this
cannot settle, buckets that still hold several components, is compared member
by member across components in blocks of ``block`` texts, with no cap: pairs
whose signatures agree enough are tested by the whole texts where they meet,
and only links that join two components leave the task.

Null or empty text: no words, so such texts are copies of each other. Rows of
the same id and words are one row of the result. A null id is never a
component's name, so such a row is kept unless its text has a row with an id.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from agora.llm.common import byte_slices, id_text, map_batches, map_rows, prepare, strings, with_blocks
from agora.llm.components import components
from agora.session import ensure_checkpoint_dir

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    width: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 4
    sketch_bits: int = 18
    sketch_depth: int = 2
    segments: int = 16
    block: int = 2048
    loose: float = 0.55     # share of equal samples from which a candidate is tested


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def shingles(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(width, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = (out * _MIX) + one[k:n - size + 1 + k]
    return np.unique(mix(out + np.uint64(size)), return_counts=True)


def cells(shingle: np.ndarray, s: Settings) -> list[np.ndarray]:
    """The sketch cell of each shingle in each of the sketch's rows."""
    return [((shingle * np.uint64(0xD6E8FEB86659FD93 + 2 * k)) >> np.uint64(64 - s.sketch_bits)).astype(np.int64)
            for k in range(s.sketch_depth)]


def document_frequencies(documents: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """(sketch of document counts by shingle, number of documents) over all documents."""
    size = s.sketch_depth << s.sketch_bits
    part = size // s.segments

    def sketch(batches):
        import pyarrow.compute  # noqa: F401
        counts, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for piece in byte_slices(batch, "text", 4 << 20):
                found = [shingles(words_of(t), s.width)[0] for t in strings(piece.column("text"))]
                n += len(found)
                if found:
                    for k, c in enumerate(cells(np.concatenate(found), s)):
                        counts[k << s.sketch_bits:(k + 1) << s.sketch_bits] += np.bincount(c, minlength=1 << s.sketch_bits)
        if n:
            kind = "<u4" if n < 1 << 32 else "<u8"
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(s.segments), pa.int32()), pa.array([n] * s.segments, pa.int64()),
                 pa.array([zlib.compress(counts[i * part:(i + 1) * part].astype(kind).tobytes(), 1)
                           for i in range(s.segments)], pa.binary())], names=["segment", "n", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total, n = np.zeros(part, np.int64), 0
        for blob, k in zip(group["counts"].to_pylist(), group["n"].to_pylist()):
            raw = zlib.decompress(blob)
            total += np.frombuffer(raw, "<u4" if len(raw) == 4 * part else "<u8").astype(np.int64)
            n += k
        return pa.table({"segment": group["segment"][:1], "n": pa.array([n], pa.int64()),
                         "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "segment int, n long, counts binary"
    rows = documents.mapInArrow(sketch, schema).groupBy("segment").applyInArrow(add, schema).collect()  # fixed size
    if not rows:
        return np.zeros((s.sketch_depth, 1 << s.sketch_bits), np.int64), 0
    rows.sort(key=lambda r: r["segment"])
    flat = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows])
    return flat.reshape(s.sketch_depth, -1), rows[0]["n"]


class Weigher:
    """Weights and signatures of texts; its size does not depend on the data."""

    def __init__(self, sketch: np.ndarray, n: int, s: Settings):
        self.s, self.n = s, n
        load = sketch.sum(1, keepdims=True) / sketch.shape[1]
        self.df = np.maximum(sketch - load, 1.0).astype(np.float32)  # a cell's count without its mean load
        rng = np.random.default_rng(11)
        size = 1 << 16
        self.r = rng.gamma(2.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.factors = (rng.integers(1 << 62, size=s.bands * s.rows, dtype=np.int64).astype(np.uint64)
                        * np.uint64(2) + np.uint64(1))

    def weights(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles and their weights."""
        s = self.s
        shingle, count = shingles(words, s.width)
        if not len(shingle):
            return shingle, np.zeros(0, np.float32)
        df = np.minimum.reduce([self.df[k][c] for k, c in enumerate(cells(shingle, s))])
        top = math.log(self.n + 1.0)
        idf = 1.0 + np.clip((top - np.log(df + 1.0)) / top, 0.0, 1.0)
        return shingle, (count * idf).astype(np.float32)

    def signature(self, words: list[str]) -> np.ndarray:
        """bands * rows ICWS samples, each hashed to 64 bits."""
        shingle, weight = self.weights(words)
        out = np.zeros(len(self.factors), np.uint64)
        if not len(shingle):
            return out
        log_w = np.log(weight)[:, None]
        step = max(1, (1 << 18) // len(shingle))
        for k in range(0, len(out), step):
            at = (shingle[:, None] * self.factors[None, k:k + step]) >> np.uint64(48)
            r = self.r[at]
            t = np.floor(log_w / r + self.beta[at])
            a = self.log_c[at] - r * (t - self.beta[at] + 1.0)
            best = a.argmin(0)
            j = np.arange(at.shape[1])
            out[k:k + step] = mix(shingle[best] + t[best, j].astype(np.int64).astype(np.uint64) * _MIX)
        return out

    def similarity(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        """Weighted Jaccard similarity of two weight vectors."""
        _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        low = float(np.minimum(a[1][i], b[1][j]).astype(np.float64).sum())
        total = float(a[1].astype(np.float64).sum() + b[1].astype(np.float64).sum())
        return low / (total - low) if total else 0.0


def digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def _signatures(documents: DataFrame, shared) -> DataFrame:
    def make():
        weigher = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [words_of(t) for t in strings(batch.column("text"))]
            memo: dict[bytes, bytes] = {}
            keys = [digest(w) for w in rows]
            for key, w in zip(keys, rows):
                if key not in memo:
                    memo[key] = weigher.signature(w).astype("<u8").tobytes() if w else b""
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array([memo[k] for k in keys], pa.binary())],
                names=["doc_id", "words", "signature"])
        return run
    return map_batches(documents, make, "doc_id long, words binary, signature binary")


def _bands(texts: DataFrame, s: Settings) -> DataFrame:
    """(band, key, rep) for every band of every text's signature."""
    def run(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u8").reshape(-1, s.bands, s.rows)
            key = np.arange(1, s.bands + 1, dtype=np.uint64)[None, :] * _MIX
            for k in range(s.rows):
                key = mix(key * _MIX + flat[:, :, k])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(s.bands, dtype=np.int32), n)), pa.array(key.ravel().view(np.int64)),
                 pa.array(np.repeat(batch.column("rep").to_numpy(), s.bands))], names=["band", "key", "rep"])
    return texts.mapInArrow(run, "band int, key long, rep long")


def _loose(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose signatures agree in a share of ``loose`` at least."""
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(-1, s.bands * s.rows) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= s.loose))
    side = lambda i, v: texts.select(F.col("rep").alias(i), F.col("signature").alias(v))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, documents: DataFrame, shared, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = documents.join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    side = lambda i, v: texts.select(F.col("doc_id").alias(i), F.col("text").alias(v))
    joined = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")

    def run(batches):
        import pyarrow.compute  # noqa: F401
        weigher, last, left = shared.value, None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if a != last:
                    last, left = a, weigher.weights(words_of(x))
                keep.append(weigher.similarity(left, weigher.weights(words_of(y))) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return joined.mapInArrow(run, "a long, b long")


def _meeting(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the texts that share a bucket, one per id. All texts are dealt for this once; those that
    meet are written, and both the leaders' test and the one across components read them there."""
    folder = f"{ensure_checkpoint_dir(documents.sparkSession)}/minhash-{uuid.uuid4().hex}"
    documents.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).write.parquet(folder)
    return documents.sparkSession.read.schema("doc_id long, text string").parquet(folder)


def _row_similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of one weight vector to each of several."""
    shingle, weight = (np.concatenate([o[k] for o in others]) for k in (0, 1))
    starts = np.cumsum([0] + [len(o[0]) for o in others[:-1]])
    at = np.minimum(np.searchsorted(one[0], shingle), len(one[0]) - 1)
    low = np.where(one[0][at] == shingle, np.minimum(one[1][at], weight), 0.0).astype(np.float64)
    low, total = np.add.reduceat(low, starts), np.add.reduceat(weight.astype(np.float64), starts)
    return low / (total + one[1].astype(np.float64).sum() - low)


def _placed(members: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """``members`` once per pair of blocks they are compared in, and the number of parts these rows are dealt into."""
    blocks = with_blocks(members, ["key"], s.block)
    rows = blocks.agg(F.sum("blocks")).first()[0] or 0  # one number
    parts = max(12, math.ceil(rows / (2 * s.block)))
    placed = (blocks.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("band", "key", "rep", "component", "block",
                      F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    return placed.withColumn("part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(parts))), parts


def _across(members: DataFrame, found: DataFrame, shared, s: Settings) -> DataFrame:
    """Links (a, b) between texts of a bucket that lie in different components so far.

    ``members``: (band, key, rep, component); ``found``: (rep, text, signature). Buckets above
    ``block`` members are compared pair of blocks by pair of blocks; the parts
    that tasks take follow from the rows after this split. A pair is
    tested in the first band it agrees in, if its signatures agree enough, by
    its whole texts; a task gives only links that join what it holds as apart.
    """
    placed = _placed(members, s)[0].join(found, "rep")

    def compare(cell: pa.Table) -> pa.Table:
        weigher = shared.value
        cell = cell.sort_by([(c, "ascending") for c in ("key", "lo", "hi", "rep")])
        band, key, lo, hi, block, rep, component = (
            cell[c].to_numpy() for c in ("band", "key", "lo", "hi", "block", "rep", "component"))
        flat = np.frombuffer(b"".join(cell["signature"].to_pylist()), "<u8").reshape(-1, s.bands, s.rows)
        texts = cell["text"]
        change = np.flatnonzero((np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        out = []
        for x, y in zip(np.concatenate([[0], change]), np.concatenate([change, [len(key)]])):
            label, vectors = component[x:y].copy(), {}

            def vector(i: int) -> tuple[np.ndarray, np.ndarray]:
                if i not in vectors:
                    vectors[i] = weigher.weights(words_of(texts[int(x) + i].as_py()))
                return vectors[i]

            for i in range(y - x - 1):
                others = np.arange(i + 1, y - x)
                others = others[label[others] != label[i]]
                if lo[x] != hi[x]:
                    others = others[block[x:y][others] != block[x + i]]
                if not len(others):
                    continue
                equal = flat[x:y][others] == flat[x + i]
                others = others[(equal.mean((1, 2)) >= s.loose) & ~equal[:, :band[x]].all(2).any(1)]
                if not len(others):
                    continue
                close = _row_similarities(vector(i), [vector(int(k)) for k in others]) >= s.threshold
                for k in others[close]:
                    if label[k] != label[i]:
                        out.append((rep[x + i], rep[x + k]))
                        label[label == label[k]] = label[i]
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return placed.groupBy("part").applyInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(doc_id, words, component_id, kept): one row per id and word sequence.

    ``words`` is a digest of the word sequence; ``component_id`` the smallest id
    of the class; ``kept`` whether the row is the class's representative.
    """
    spark = df.sparkSession
    prepare(spark)
    documents = id_text(df, id_col, text_col)
    sketch, n = document_frequencies(documents, s)
    shared = spark.sparkContext.broadcast(Weigher(sketch, n, s))
    signed = _signatures(documents, shared).checkpoint()
    texts = (signed.where(F.col("doc_id").isNotNull() & (F.length("signature") > 0))
             .groupBy("words").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
             .select("rep", "signature").checkpoint())
    banded = _bands(texts, s).checkpoint()
    led = (banded.groupBy("key").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > 1).select("key", "a"))
    first = banded.join(led, "key").where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")).distinct()
    meeting = _meeting(documents, banded.join(led, "key").select(F.col("rep").alias("doc_id")).distinct())
    links = verified(_loose(first, texts, s).checkpoint(), meeting, shared, s.threshold).checkpoint()
    classes = components(links).checkpoint()

    open_ = (banded.join(led, "key").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
             .select("band", "key", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = (open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where(F.col("lo") != F.col("hi")).select("key"))
    members = open_.join(mixed, "key", "left_semi").checkpoint()
    found = meeting.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = found.select(F.col("doc_id").alias("rep"), "text").join(texts, "rep")
    more = _across(members, found, shared, s)
    edges = more.unionByName(classes.where(F.col("node") != F.col("component"))
                             .select(F.col("component").alias("a"), F.col("node").alias("b")))
    classes = components(edges.checkpoint())

    reps = (signed.where(F.col("doc_id").isNotNull()).groupBy("words").agg(F.min("doc_id").alias("rep"))
            .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
            .select("words", F.coalesce("component", "rep").alias("component_id")))
    return (signed.select("doc_id", "words").distinct().join(reps, "words", "left")
            .select("doc_id", "words", "component_id")
            .withColumn("kept", F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))))


def representatives(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row of ``documents``, all columns, of each class of near-duplicates.

    Rows of the same id and words count as one, that of the smallest hash; of
    texts without any id in their class, one row stays.
    """
    # keys without nulls, so that the join's own dealing serves the choice among equal rows and texts move once
    key = [F.coalesce("doc_id", F.lit(0)).alias("kept_id"), F.col("doc_id").isNull().alias("no_id"), F.col("words").alias("kept_words")]
    names = ["kept_id", "no_id", "kept_words"]
    kept = near_duplicates(documents, s=s).where("kept").select(*key)

    def make():
        def run(texts: list[str]) -> list[pa.Array]:
            return [pa.array([digest(words_of(t)) for t in texts], pa.binary())]
        return run
    rows = map_rows(documents, make, [StructField("words", BinaryType())]).select(
        "*", F.col("row.doc_id").cast("long").alias("doc_id"))
    first = F.min_by("row", F.xxhash64("row"))  # the same one whenever a task runs again
    return rows.select("row", *key).join(kept, names, "left_semi").groupBy(*names).agg(first.alias("row")).select("row.*")
