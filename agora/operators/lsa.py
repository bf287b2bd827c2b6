"""A dense space for comments: truncated SVD of their TF-IDF matrix (M4).

The words of a comment are hashed into ``buckets`` columns, weighted by
tf * idf and scaled to length one; that is a row of the matrix A. The leading
right singular vectors of A come from a randomised range finder: a random
basis of ``dim + oversample`` columns is multiplied by A'A, what is new in the
product is the next basis, and the singular values are those of A within all
bases so far (a block Krylov space, which settles in far fewer passes than the
last basis alone). A comment's vector is its row times the singular vectors,
scaled to length one, so comments that share no word are still near if their
words occur with the same other words.

What a pass over the comments costs does not grow with them beyond the pass
itself: every task multiplies its rows by Q (a bounded number of entries at a
time, common columns as a dense matrix and the others entry by entry) and returns one buckets x columns sum, and those sums are
added up by Spark in two levels. Q and the sums have a size fixed by the
parameters (8,192 x 400 doubles are 26 MB), whatever the corpus; only they pass
through the driver, where the small QR and eigenvalue steps are done.

Nulls and comments without a word have the zero vector, which
``embed.persistable`` leaves out. An empty table gives an empty space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.text import word_tokens

BUCKETS = 1 << 13
#: Entries and rows of A multiplied at a time, and (BLOCK) rows of a sum sent as one cell.
CHUNK = 1 << 19
CHUNK_ROWS = 1024
#: A column that one in so many rows has is multiplied as dense.
COMMON = 12
BLOCK = 256
#: Sums added up in one task of the first level.
FAN_IN = 64


@dataclass
class Space:
    """idf per bucket, singular values (descending), right singular vectors (buckets x dim)."""

    idf: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def hashed(comments: DataFrame, buckets: int, key: str = "comment_id", body: str = "body") -> DataFrame:
    """(key, words): the bucket of every word of a comment, in order; repeated words repeat."""
    return comments.select(F.col(key), word_tokens(F.col(body)).alias("words")).select(
        F.col(key), F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")).alias("words"))


def inverse_frequencies(rows: DataFrame, buckets: int) -> np.ndarray:
    """ln((n + 1) / (df + 1)) per bucket; at most one row a bucket reaches the driver."""
    n = rows.count()
    counts = (rows.select(F.explode(F.array_distinct("words")).alias("bucket"))
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("df")).toPandas())
    df = np.zeros(buckets)
    df[counts["bucket"].to_numpy(dtype=int)] = counts["df"]
    return np.log((n + 1.0) / (df + 1.0))


def chunks(words: pd.Series, idf: np.ndarray) -> Iterator[tuple[np.ndarray, Chunk]]:
    """Unit rows of A in chunks of at most CHUNK_ROWS rows and about CHUNK entries, and their positions in ``words``.
    Zero rows are left out."""
    where, rows, size = [], [], 0
    common = np.flatnonzero(idf < np.log(COMMON))

    def block():
        return np.array(where), Chunk(np.cumsum([0, *(len(c) for c, _ in rows)]), np.concatenate([c for c, _ in rows]),
                                      np.concatenate([v for _, v in rows]), common, len(idf))

    for position, row in enumerate(words):
        column, count = np.unique(np.asarray(row if row is not None else [], dtype=np.int64), return_counts=True)
        value = count * idf[column]
        length = np.sqrt(value @ value)
        if length > 0:
            where.append(position)
            rows.append((column, value / length))
            size += len(column)
        if size >= CHUNK or len(rows) >= CHUNK_ROWS:
            yield block()
            where, rows, size = [], [], 0
    if rows:
        yield block()


def sums_of(begins: np.ndarray, at: np.ndarray, value: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Per run of entries, the sum of its values times the rows ``at`` of ``dense``. Zeros are neither stored nor
    multiplied, as they would be in a dense chunk whose columns are those of all its rows."""
    out = np.empty((len(begins) - 1, dense.shape[1]))
    part = np.empty((max(np.diff(begins).max(initial=0), 1), dense.shape[1]))
    for k, (i, j) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
        taken = np.take(dense, at[i:j], axis=0, out=part[:j - i], mode="clip")
        np.dot(value[i:j], taken, out=out[k])
    return out


class Chunk:
    """Rows of A: columns that many rows have as a dense matrix, the entries of the others one by one."""

    def __init__(self, begins: np.ndarray, column: np.ndarray, value: np.ndarray, common: np.ndarray, buckets: int):
        slot = np.full(buckets, -1)
        slot[common] = np.arange(len(common))
        row, at = np.repeat(np.arange(len(begins) - 1), np.diff(begins)), slot[column]
        dense, rare = at >= 0, at < 0
        self.common, self.dense = common, np.zeros((len(begins) - 1, len(common)))
        self.dense[row[dense], at[dense]] = value[dense]
        self.row, self.column, self.value = row[rare], column[rare], value[rare]

    def times(self, basis: np.ndarray) -> np.ndarray:
        begins = np.searchsorted(self.row, np.arange(len(self.dense) + 1))
        return self.dense @ basis[self.common] + sums_of(begins, self.column, self.value, basis)

    def add_gram(self, total: np.ndarray, basis: np.ndarray) -> None:
        """``total`` += B'B basis for the rows B: row by row, then column by column."""
        image = self.times(basis)
        total[self.common] += self.dense.T @ image
        order = np.argsort(self.column, kind="stable")
        first = np.flatnonzero(np.diff(self.column[order], prepend=-1))
        total[self.column[order[first]]] += sums_of(np.append(first, len(order)), self.row[order], self.value[order], image)


def _summed(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """One cell of the sum; parts are added in their own order, so a rerun agrees."""
    frame = frame.sort_values("part")
    total = np.frombuffer(frame["cell"].iloc[0]).copy()
    for cell in frame["cell"].iloc[1:]:
        total += np.frombuffer(cell)
    return pd.DataFrame({"block": [keys[0]], "part": [frame["part"].iloc[0]], "cell": [total.tobytes()]})


def gram_times(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis, in one pass over ``rows``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((idf, basis))  # fixed by the parameters

    def partial(frames):
        from pyspark import TaskContext
        weights, q = shared.value
        total, seen = np.zeros_like(q), False
        for frame in frames:
            for _, chunk in chunks(frame["words"], weights):
                chunk.add_gram(total, q)
                seen = True
        if seen:
            part = TaskContext.get().partitionId()
            for block in range(0, len(total), BLOCK):
                yield pd.DataFrame({"block": [block], "part": [part], "cell": [total[block:block + BLOCK].tobytes()]})

    schema = "block int, part int, cell binary"
    cells = rows.select("words").mapInPandas(partial, schema)
    lanes = cells.groupBy("block", F.floor(F.col("part") / FAN_IN).alias("lane")).applyInPandas(_summed, schema)
    out = np.zeros_like(basis)
    for row in lanes.groupBy("block").applyInPandas(_summed, schema).collect():  # buckets x columns in all
        out[row["block"]:row["block"] + BLOCK] = np.frombuffer(row["cell"]).reshape(-1, basis.shape[1])
    shared.destroy()
    return out


def _new_directions(space: np.ndarray, image: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``image`` adds to ``space``; no columns if it adds nothing."""
    size = np.abs(image).max(initial=0.0)
    for _ in range(2):
        image = image - space @ (space.T @ image)
    basis, triangle = np.linalg.qr(image)
    basis = basis[:, np.abs(np.diag(triangle)) > 1e-9 * size]
    if basis.shape[1]:
        basis, _ = np.linalg.qr(basis - space @ (space.T @ basis))
    return basis


def fit(comments: DataFrame, dim: int = lexicon.EMBEDDING_DIM, oversample: int = 16, buckets: int = BUCKETS,
        tolerance: float = 2e-3, max_passes: int = 5, seed: int = 42,
        key: str = "comment_id", body: str = "body") -> Space:
    """The space of ``comments``. Passes end when none of the ``dim`` singular values grows by more than
    ``tolerance`` of itself (they grow towards the true ones), or after ``max_passes``."""
    if not 1 <= dim <= buckets:
        raise ValueError("dim must be 1..buckets")
    rows = hashed(comments, buckets, key, body).persist()
    try:
        idf = inverse_frequencies(rows, buckets)
        width = min(dim + oversample, buckets)
        basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width)))
        values, space, images = np.zeros(dim), np.empty((buckets, 0)), np.empty((buckets, 0))
        for _ in range(max_passes):
            image = gram_times(rows, idf, basis)
            space, images = np.hstack([space, basis]), np.hstack([images, image])
            within = space.T @ images
            squares, turn = np.linalg.eigh((within + within.T) / 2)  # ascending
            squares, turn = squares[::-1], turn[:, ::-1]
            last, values = values, np.sqrt(np.maximum(squares[:dim], 0.0))
            vectors = space @ turn[:, :dim]
            real = values > 1e-7 * max(values[0], 1e-300)
            if np.all(values[real] - last[real] <= tolerance * values[real]):
                break
            basis = _new_directions(space, image)
            if not basis.shape[1]:
                break
    finally:
        rows.unpersist()
    vectors = np.where(real, vectors, 0.0)  # directions that A doesn't have
    largest = np.abs(vectors).argmax(axis=0)
    sign = np.where(vectors[largest, np.arange(dim)] < 0, -1.0, 1.0)
    return Space(idf, np.where(real, values, 0.0), vectors * sign)


def embed(comments: DataFrame, space: Space, key: str = "comment_id", body: str = "body") -> DataFrame:
    """M4: (key, embedding array<float>, is_zero), as ``embed.embed`` returns them."""
    buckets = len(space.idf)
    shared = comments.sparkSession.sparkContext.broadcast((space.idf, space.vectors))  # fixed by the parameters
    rows = hashed(comments, buckets, key, body)
    kind = rows.schema[key].dataType.simpleString()

    def project(frames):
        idf, vectors = shared.value
        for frame in frames:
            out = np.zeros((len(frame), vectors.shape[1]), dtype=np.float32)
            for where, chunk in chunks(frame["words"], idf):
                image = chunk.times(vectors)
                length = np.linalg.norm(image, axis=1, keepdims=True)
                out[where] = np.round(np.divide(image, length, out=np.zeros_like(image), where=length > 1e-9), 6)
            yield pd.DataFrame({key: frame[key], "embedding": list(out), "is_zero": ~out.any(axis=1)})

    return rows.mapInPandas(project, f"`{key}` {kind}, embedding array<float>, is_zero boolean")
