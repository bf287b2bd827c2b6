"""Embedding near-duplicates by iterative quantisation (ITQ) and multi-index Hamming tables.

Fitting. From at most ``sample`` vectors (those with the smallest hash of
their id) comes a principal-component projection and, from several random
starts, rotations that bring the projected vectors closest to their signs:
balanced binary codes of up to 64 bits per rotation. The sample fits the
index only; every vector is indexed.

Retrieval. A code is cut into substrings of about log2(number of vectors)
bits; each is one hash table. Vectors that meet in a table are compared by
their original components in double precision. The number of tables follows
from the wanted chance, ``recall``, that a pair at the threshold meets in at
least one, as a bit differs with probability angle / pi.

A pair may meet in several tables: it counts in the first one only, which
both codes tell. Exact copies are one vector with a number of copies. A table
cell that holds more than ``block`` vectors is split into blocks of that size
and compared pair of blocks by pair of blocks, whole and in separate tasks.
Tasks return link counts and a spanning forest, never pairs.

Vectors that are null, zero, hold a null or non-finite component, or have
another length than most link with nothing; so does a row with a null id.
Repeated rows of one id and vector are one row of the result; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import prepare, with_blocks
from agora.llm.components import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    recall: float = 0.9995
    sample: int = 10_000
    iterations: int = 40
    block: int = 4096
    seed: int = 7


@dataclass(frozen=True)
class Index:
    mean: np.ndarray            # of the sample's unit vectors
    planes: list[np.ndarray]    # one projection with rotation per code
    bits: int                   # of a substring
    tables: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Substring values, one column per table."""
        out = []
        for plane in self.planes:
            code = (unit - self.mean) @ plane > 0
            for start in range(0, code.shape[1] - self.bits + 1, self.bits):
                if len(out) < self.tables:
                    out.append(code[:, start:start + self.bits] @ (1 << np.arange(self.bits, dtype=np.int64)))
        return np.stack(out, 1)


def itq(projected: np.ndarray, rng: np.random.Generator, iterations: int) -> np.ndarray:
    """The rotation that brings ``projected`` closest to its own signs, from a random start."""
    d = projected.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    for _ in range(iterations):
        left, _, right = np.linalg.svd(projected.T @ np.where(projected @ rotation > 0, 1.0, -1.0))
        rotation = left @ right
    return rotation


def fit_index(sample: np.ndarray, n: int, s: Settings) -> Index:
    """``sample``: unit vectors; ``n``: how many vectors will be indexed."""
    rng = np.random.default_rng(s.seed)
    d = sample.shape[1]
    mean = sample.mean(0)
    axes = np.linalg.svd((sample - mean).T @ (sample - mean))[0][:, :min(d, 64)]
    bits = min(axes.shape[1], max(6, math.ceil(math.log2(max(2, n))) - 2))
    same = (1 - math.acos(min(1.0, s.threshold)) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(1 - s.recall) / math.log(1 - same))) if same < 1 else 1
    per_code = axes.shape[1] // bits
    projected = (sample - mean) @ axes
    planes = [axes @ itq(projected, rng, s.iterations) for _ in range(math.ceil(tables / per_code))]
    return Index(mean, planes, bits, tables)


def _units(column: pa.Array, d: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), "<f4").astype(np.float64).reshape(-1, d)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _cell(unit_a, keys_a, unit_b, keys_b, same: bool, table: int, threshold: float, step: int = 1024):
    """(rows, columns) of the pairs of a cell that are linked and meet in no earlier table."""
    for start in range(0, len(unit_a), step):
        linked = unit_a[start:start + step] @ unit_b.T >= threshold
        if same:
            rows = np.arange(start, min(start + step, len(unit_a)))
            linked[rows - start, rows] = False
        i, j = np.nonzero(linked)
        for k in range(0, len(i), 1 << 18):
            a, b = i[k:k + (1 << 18)] + start, j[k:k + (1 << 18)]
            if table:
                first = ~(keys_a[a, :table] == keys_b[b, :table]).any(1)
                a, b = a[first], b[first]
            yield a, b


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _placed(coded: DataFrame, row_bytes: int, s: Settings) -> tuple[DataFrame, int]:
    """Every vector once per table and pair of blocks it is compared in, and the number of parts these rows are dealt into."""
    blocks = with_blocks(coded.select("rep", "copies", "vector", "keys", F.posexplode("keys").alias("t", "key")),
                         ["t", "key"], s.block)
    rows = blocks.agg(F.sum("blocks")).first()[0] or 0  # one number
    parts = max(12, math.ceil(rows * row_bytes / (24 << 20)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = (blocks.withColumn("block", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")))
    return placed.withColumn("part", F.pmod(F.xxhash64("t", "key", "lo", "hi"), F.lit(parts))), parts


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    s: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every distinct row of (id, vector)."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"),
                     F.col(vector_col).cast("array<float>").alias("v")).distinct()
    length = (rows.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).count()
              .orderBy(F.desc("count"), "d").first())
    d = length["d"] if length else 0
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = (rows.where(F.col("vec_id").isNotNull() & (F.size("v") == d) & finite & F.exists("v", lambda x: x != 0))
             if d else rows.where(F.lit(False)))
    distinct = valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).checkpoint()
    n = distinct.count()
    if n < 2:
        return _result(rows, distinct, None, None)
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(s.sample).select("v").toArrow()["v"]  # bounded by s.sample
    flat = sample.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, d)
    index = fit_index(flat / np.linalg.norm(flat, axis=1, keepdims=True), n, s)
    shared = spark.sparkContext.broadcast(index)

    def code(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy().astype("<f4").reshape(-1, d)
            unit = flat.astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            keys = shared.value.keys(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"),
                 pa.array([x.tobytes() for x in flat], pa.binary()),
                 pa.array(list(keys), pa.list_(pa.int64()))], names=["rep", "copies", "vector", "keys"])

    coded = distinct.mapInArrow(code, "rep long, copies long, vector binary, keys array<long>").checkpoint()
    placed, _ = _placed(coded, 4 * d + 8 * index.tables + 64, s)
    threshold, tables = s.threshold, index.tables

    def compare(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([(c, "ascending") for c in ("t", "key", "lo", "hi", "rep")]).combine_chunks()
        t, key, lo, hi, block = (cell[c].to_numpy() for c in ("t", "key", "lo", "hi", "block"))
        change = np.flatnonzero((np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(t)]])
        rep, copies = cell["rep"].to_numpy(), cell["copies"].to_numpy()
        out = []
        for x, y in zip(starts, ends):
            if y - x < 2:
                continue
            unit = _units(cell["vector"].slice(x, y - x), d)
            keys = (cell["keys"].slice(x, y - x).combine_chunks().flatten().to_numpy().reshape(-1, tables))
            if lo[x] == hi[x]:
                left = right = np.arange(y - x)
            else:
                left, right = np.flatnonzero(block[x:y] == lo[x]), np.flatnonzero(block[x:y] == hi[x])
            links, ai, bi = np.zeros(y - x, np.int64), [], []
            for a, b in _cell(unit[left], keys[left], unit[right], keys[right], lo[x] == hi[x], int(t[x]), threshold):
                a, b = left[a], right[b]
                np.add.at(links, a, copies[x:y][b])
                if lo[x] != hi[x]:
                    np.add.at(links, b, copies[x:y][a])
                ai.append(a)
                bi.append(b)
            if links.any():
                root = forest(y - x, np.concatenate(ai), np.concatenate(bi))
                on = np.flatnonzero(links)
                out.append((rep[x:y][on], links[on], rep[x:y][root[on]]))
        columns = zip(*out) if out else [[np.zeros(0, np.int64)]] * 3
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in zip(("rep", "links", "root"), columns)})

    found = (placed.groupBy("part").applyInArrow(compare, "rep long, links long, root long").checkpoint())
    return _result(rows, distinct, found.groupBy("rep").agg(F.sum("links").alias("links")),
                   components(found.select("rep", "root")))


def _result(rows: DataFrame, distinct: DataFrame, links: DataFrame | None, classes: DataFrame | None) -> DataFrame:
    known = distinct
    if links is not None:
        known = (known.join(links, "rep", "left")
                 .join(classes.withColumnRenamed("node", "rep"), "rep", "left"))
    else:
        known = known.withColumns({"links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    known = known.select("v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component_id"))
    # the vector of most rows has one copy, which its own id finds; the others are found by their components
    out = rows.join(known.withColumnRenamed("v", "kv"), (F.col("v") == F.col("kv")) & F.col("vec_id").isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
