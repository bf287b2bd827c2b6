"""Grouped k-means over blocks of points (M6): sampled seeding and pruned assignment.

Points of a (topic, stance) bucket are dealt by a hash of their id to blocks of
about ``BLOCK`` vectors. Blocks are cached once and never move again: what
changes from round to round (each point's cluster and bounds, 20 bytes against
a whole vector) is a small state row per block, written to the shared checkpoint
folder every round, which is joined back to its block. A bucket of any size is many blocks, so no task
holds a whole bucket.

Seeding is k-means||: each round draws ``2 * k`` points per bucket, without
replacement and with odds by squared distance to the candidates so far (the
smallest exponential keys, from a hash of id and round, so that a task run
again draws the same points). Candidates, weighted by the points nearest to
them, are reclustered to k by weighted k-means++ and Lloyd steps: at most
``1 + rounds * 2 * k`` rows per bucket, whatever its size.

Assignment keeps an upper bound of a point's distance to its centroid and a
lower bound of that to any other; centroid moves widen them, and only points
whose bounds cross compute distances. Results equal plain Lloyd steps.

Fewer than two points make no clusters. Points without id, topic, stance or
vector, or with a null or non-finite component, take no part. Equal distances
go to the lower cluster. A centroid without points stays where it is and is
left out of the result if it has none in the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.session import ensure_checkpoint_dir

BUCKET = ["topic_id", "stance"]
KEY = [*BUCKET, "block"]
BLOCK = 2048
ROUNDS = 4

_KEY_DDL = "topic_id long, stance string, block long"
_SEED_DDL = f"{_KEY_DDL}, d binary, near array<int>, cands array<struct<draw:double,id:long,vec:array<double>>>"
_STEP_DDL = (f"{_KEY_DDL}, a array<int>, u binary, l binary, sums array<array<double>>, sizes array<long>, "
             "computed long")
_CENTRE_DDL = "topic_id long, stance string, cluster int, vec array<double>"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read back (checkpoint() computes them twice)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/kmeans-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def usable(points: DataFrame) -> DataFrame:
    """Points that can be clustered, with bigint topics."""
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return points.select(F.col("topic_id").cast("long"), "stance", F.col("comment_id").cast("long"), "vec").where(
        F.col("topic_id").isNotNull() & F.col("stance").isNotNull() & F.col("comment_id").isNotNull() & finite)


def blocks(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per block: its ids in order and their vectors as one matrix of doubles."""
    counts = points.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    dealt = points.join(counts, BUCKET).withColumn(
        "block", F.pmod(F.xxhash64("comment_id"), F.ceil(F.col("n") / size)))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("comment_id", kind="stable")
        return pd.DataFrame([[*key, rows["comment_id"].tolist(), np.vstack(rows["vec"]).astype("<f8").tobytes()]],
                            columns=[*KEY, "ids", "vecs"])

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = dealt.select(*KEY, "comment_id", "vec").groupBy(*KEY).applyInPandas(
        pack, f"{_KEY_DDL}, ids array<long>, vecs binary")
    # a stated number of partitions, so that joins on the key find the cached rows in place
    return packed.repartition(parts, *KEY).persist(StorageLevel.MEMORY_AND_DISK)


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) by the splitmix64 finaliser of id and salt."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _sq_dists(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _per_block(run: Callable) -> Callable:
    """Apply ``run`` (row -> output row) to each row of the batches."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame([run(row)])
    return work


def _vectors(row) -> np.ndarray:
    return np.frombuffer(row.vecs, "<f8").reshape(len(row.ids), -1)


def sampled_seeds(packed: DataFrame, k: int, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """k-means||: (topic_id, stance, cluster, vec), at most k per bucket."""
    take = 2 * k

    def draw(row, salt: int) -> dict:
        x, ids = _vectors(row), np.asarray(row.ids)
        d, near = np.frombuffer(row.d, "<f8").copy(), np.array(row.near)
        for c in sorted(row.new, key=lambda c: c["number"]):
            dist = ((x - np.asarray(c["vec"])) ** 2).sum(axis=1)
            closer = dist < d
            d[closer], near[closer] = dist[closer], c["number"]
        left = np.flatnonzero(d > 0)
        keys = -np.log(_uniform(ids[left], salt)) / d[left]
        best = left[np.lexsort((ids[left], keys))[:take]]
        values = -np.log(_uniform(ids[best], salt)) / d[best]
        return {**{c: getattr(row, c) for c in KEY}, "d": d.astype("<f8").tobytes(), "near": near.tolist(),
                "cands": [{"draw": float(v), "id": int(ids[i]), "vec": x[i].tolist()} for v, i in zip(values, best)]}

    def fresh(row) -> dict:
        x, ids = _vectors(row), np.asarray(row.ids)
        keys = _uniform(ids, seed)
        i = int(np.lexsort((ids, keys))[0])
        return {**{c: getattr(row, c) for c in KEY}, "d": np.full(len(ids), np.inf).astype("<f8").tobytes(),
                "near": [-1] * len(ids), "cands": [{"draw": float(keys[i]), "id": int(ids[i]), "vec": x[i].tolist()}]}

    state = stored(packed.mapInPandas(_per_block(fresh), _SEED_DDL))
    candidates, base = None, 0
    for r in range(rounds + 1):
        quota = take if r else 1
        w = Window.partitionBy(*BUCKET).orderBy("c.draw", "c.id")
        new = stored(state.select(*BUCKET, F.explode("cands").alias("c"))
                     .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)
                     .select(*BUCKET, (F.col("rank") - 1 + base).alias("number"), F.col("c.vec").alias("vec")))
        candidates = new if candidates is None else candidates.unionByName(new)
        base += quota
        per_bucket = new.groupBy(*BUCKET).agg(F.collect_list(F.struct("number", "vec")).alias("new"))
        # a bucket whose points all coincide with candidates draws no more
        given = state.select(*KEY, "d", "near").join(per_bucket, BUCKET, "left").withColumn(
            "new", F.coalesce("new", F.array().cast("array<struct<number:int,vec:array<double>>>")))
        state = stored(packed.join(given, KEY).mapInPandas(
            _per_block(lambda row, salt=seed + r + 1: draw(row, salt)), _SEED_DDL))
    weights = (state.select(*BUCKET, F.explode("near").alias("number"))
               .groupBy(*BUCKET, "number").agg(F.count(F.lit(1)).alias("weight")))

    def recluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number")
        centres = weighted_kmeans(np.vstack(rows["vec"]), rows["weight"].to_numpy(float), k, seed)
        return pd.DataFrame({"topic_id": key[0], "stance": key[1], "cluster": np.arange(len(centres), dtype=np.int32),
                             "vec": centres.tolist()})

    return candidates.join(weights, [*BUCKET, "number"]).groupBy(*BUCKET).applyInPandas(recluster, _CENTRE_DDL)


def weighted_kmeans(x: np.ndarray, weight: np.ndarray, k: int, seed: int, trials: int = 8, steps: int = 20) -> np.ndarray:
    """Best of ``trials`` weighted k-means++ starts, each improved by Lloyd steps; at most k distinct centres."""
    best, least = x[:1], np.inf
    for trial in range(trials):
        rng = np.random.default_rng([seed, trial])
        chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
        d = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k and (odds := d * weight).sum() > 0:
            chosen.append(int(rng.choice(len(x), p=odds / odds.sum())))
            d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        centres = x[chosen].copy()
        for _ in range(steps):
            a = _sq_dists(x, centres).argmin(axis=1)
            for j in np.unique(a):
                centres[j] = np.average(x[a == j], axis=0, weights=weight[a == j])
        cost = float((_sq_dists(x, centres).min(axis=1) * weight).sum())
        if cost < least:
            best, least = centres, cost
    return best


def settle(x: np.ndarray, centres: np.ndarray, moves: np.ndarray, a: np.ndarray | None, u: np.ndarray | None,
           low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One assignment. (clusters, upper bounds, lower bounds, points that computed all distances).

    ``moves``: how far each centre went since the bounds were made."""
    n = len(x)
    if a is None:
        a, u, low, loose = np.zeros(n, np.int64), np.empty(n), np.empty(n), np.arange(n)
    else:
        a, u, low = a.astype(np.int64), u + moves[a], low - moves.max()
        between = np.sqrt(_sq_dists(centres, centres))
        np.fill_diagonal(between, np.inf)
        bound = np.maximum(low, between.min(axis=1)[a] / 2)
        # a margin for rounding: near ties are computed
        loose = np.flatnonzero(u * (1 + 1e-9) + 1e-12 >= bound)
        u[loose] = np.sqrt(((x[loose] - centres[a[loose]]) ** 2).sum(axis=1))
        loose = loose[u[loose] * (1 + 1e-9) + 1e-12 >= bound[loose]]
    if len(loose):
        dists = np.sqrt(_sq_dists(x[loose], centres))
        rows, own = np.arange(len(loose)), dists.argmin(axis=1)
        a[loose], u[loose] = own, dists[rows, own]
        dists[rows, own] = np.inf
        low[loose] = dists.min(axis=1)
    return a, u, low, len(loose)


def _step(row) -> dict:
    x = _vectors(row)
    cents = sorted(row.cents, key=lambda c: c["cluster"])
    centres = np.array([c["vec"] for c in cents], dtype=float)
    before = row.a is not None
    a, u, low, computed = settle(
        x, centres, np.array([c["drift"] for c in cents]), np.array(row.a) if before else None,
        np.frombuffer(row.u, "<f8") if before else None, np.frombuffer(row.l, "<f8") if before else None)
    sums = np.zeros_like(centres)
    np.add.at(sums, a, x)
    return {**{c: getattr(row, c) for c in KEY}, "a": a.tolist(), "u": u.astype("<f8").tobytes(),
            "l": low.astype("<f8").tobytes(), "sums": sums.tolist(),
            "sizes": np.bincount(a, minlength=len(centres)).tolist(), "computed": computed}


def assign_blocks(packed: DataFrame, cents: DataFrame, state: DataFrame | None) -> DataFrame:
    """State after one assignment to ``cents`` (cluster 0 up to their number, vec, drift), stored."""
    table = cents.groupBy(*BUCKET).agg(F.collect_list(F.struct("cluster", "vec", "drift")).alias("cents"))
    if state is None:
        state = packed.select(*KEY, F.lit(None).cast("array<int>").alias("a"), F.lit(None).cast("binary").alias("u"),
                              F.lit(None).cast("binary").alias("l"))
    given = state.select(*KEY, "a", "u", "l").join(table, BUCKET)
    return stored(packed.join(given, KEY).mapInPandas(_per_block(_step), _STEP_DDL))


def means(state: DataFrame) -> DataFrame:
    """(topic_id, stance, cluster, vec, size) of clusters with points; blocks' sums combine before the shuffle."""
    parts = state.select(*BUCKET, F.posexplode(F.arrays_zip("sums", "sizes")).alias("cluster", "p")).where(
        F.col("p.sizes") > 0)
    total = parts.groupBy(*BUCKET, "cluster").agg(
        Summarizer.sum(array_to_vector(F.col("p.sums"))).alias("total"), F.sum("p.sizes").alias("size"))
    return total.select(*BUCKET, "cluster", F.transform(
        vector_to_array("total"), lambda v: v / F.col("size")).alias("vec"), "size")


def moved(state: DataFrame, cents: DataFrame) -> DataFrame:
    """Centroids after a step, with the distance each has moved."""
    gap = F.aggregate(F.zip_with("vec", "old", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    old = cents.select(*BUCKET, "cluster", F.col("vec").alias("old"))
    new = means(state).select(*BUCKET, "cluster", F.col("vec").alias("mean"))
    return (old.join(new, [*BUCKET, "cluster"], "left")
            .select(*BUCKET, "cluster", F.coalesce("mean", "old").alias("vec"), "old")
            .select(*BUCKET, "cluster", "vec", F.sqrt(gap).alias("drift")))


def lloyd(packed: DataFrame, seeds: DataFrame, max_iter: int, tol: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(clusters, assignments, per step a row per block: the points that computed all distances)."""
    small = max(1, packed.sparkSession.sparkContext.defaultParallelism)
    cents = stored(seeds.select(*BUCKET, "cluster", "vec", F.lit(0.0).alias("drift")).coalesce(small))
    state, work, still = None, [], False
    for _ in range(max_iter):
        state = assign_blocks(packed, cents, state)
        work.append(state.select("computed"))
        cents = stored(moved(state, cents).coalesce(small))
        furthest = cents.agg(F.max("drift")).first()[0]
        if still := furthest is None or furthest * furthest <= tol:
            break
    if not still:
        state = assign_blocks(packed, cents, state)
        work.append(state.select("computed"))
    assigned = packed.join(state.select(*KEY, "a"), KEY).select(
        *BUCKET, F.explode(F.arrays_zip("ids", "a")).alias("p")).select(
        *BUCKET, F.col("p.ids").alias("comment_id"), F.col("p.a").alias("cluster"))
    return means(state), assigned, work
