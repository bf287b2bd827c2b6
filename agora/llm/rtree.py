"""Hard-negative mining with STR-packed R-trees over integer vectors.

Every row takes part in one tree. Rows are dealt into tiles by label, first
coordinate and a hash of the id (range partitioning, so equal vectors spread
too); a tile's rows are packed by sort-tile-recursive: per label, slabs by the
coordinate of the widest spread, in them runs by the second widest. A run is a
leaf with its minimum bounding box; neighbouring leaves make an inner node.
Leaves are written as rows of a checkpointed table.

A box gives, coordinate by coordinate, the interval an anchor's inner product
with its rows lies in. Anchors search every tile in blocks (block of anchors,
tile), each with a best-first queue of boxes by upper bound. Positives: the
``positives`` best rows of the anchor's label; a box strictly below the k-th
best so far is pruned, and the k-th best in the anchor's own tile is where
every tile starts. Negatives: for each positive score p the ``negatives`` best
rows of another label with ``low`` * p <= 100 * score <= ``high`` * p; a box
outside all score windows, or strictly below the k-th best of those it meets,
is pruned. A tile returns its best rows per anchor (and window), and those are
ranked again over all tiles: by score, ties by smaller id. Nothing is cut but by
rank. Scores are exact integers (64 bits; beyond that they wrap).

Rows with a null id, label or vector, with a null component, or with another
length than most (ties: the shorter) take no part. Rows repeated whole are one
row; rows that share an id but differ take part one by one, and none of them is a positive of another.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import prepare


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    low: int = 50          # percent of the positive's score
    high: int = 95
    leaf: int = 128        # rows of a leaf
    fan: int = 16          # leaves of an inner node
    tile: int = 8192       # rows of a tile
    block: int = 1024      # anchors that search a tile together


_LEAVES = "tile int, aid long, vec_id binary, label long, rows binary, low binary, high binary, floor long"
_NONE = np.iinfo(np.int64).min


def str_pack(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves: slabs by the widest coordinate, runs of ``leaf`` by the second widest in each."""
    wide = np.argsort(-rows.astype(np.float64).var(0), kind="stable")
    first, second = wide[0], wide[min(1, len(wide) - 1)]
    slab = leaf * math.ceil(math.sqrt(math.ceil(len(rows) / leaf)))
    by = np.argsort(rows[:, first], kind="stable")
    out = []
    for x in range(0, len(by), slab):
        part = by[x:x + slab]
        part = part[np.argsort(rows[part, second], kind="stable")]
        out += [part[y:y + leaf] for y in range(0, len(part), leaf)]
    return out


class Tree:
    """Leaves of a tile under inner nodes; bounds of a block of anchors' inner products by matrix products."""

    def __init__(self, labels: np.ndarray, ids: list[np.ndarray], rows: list[np.ndarray],
                 low: np.ndarray, high: np.ndarray, fan: int):
        self.labels, self.ids, self.rows, self.low, self.high = labels, ids, rows, low, high
        starts = np.arange(0, len(labels), fan)
        self.kids = [range(x, min(x + fan, len(labels))) for x in starts]
        self.node_low, self.node_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)

    @staticmethod
    def interval(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, one row per anchor and one column per box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ low.T + down @ high.T, up @ high.T + down @ low.T

    def bounds(self, anchors: np.ndarray):
        return *self.interval(anchors, self.low, self.high), *self.interval(anchors, self.node_low, self.node_high)

    def best(self, leaf_low, leaf_high, node_low, node_high, wanted, key, visit) -> None:
        """Best-first over one anchor's boxes. ``key(low, high)``: a box's place in the queue, None if it is pruned now."""
        queue = []
        for i in range(len(self.kids)):
            k = key(node_low[i], node_high[i])
            if k is not None:
                heapq.heappush(queue, (-k, 0, i))
        while queue:
            _, is_leaf, i = heapq.heappop(queue)
            if is_leaf:
                if key(leaf_low[i], leaf_high[i]) is not None:
                    visit(i)
            elif key(node_low[i], node_high[i]) is not None:
                for j in self.kids[i]:
                    if wanted[j]:
                        k = key(leaf_low[j], leaf_high[j])
                        if k is not None:
                            heapq.heappush(queue, (-k, 1, j))


def _merge(scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray, k: int):
    """The first k of both, by score downwards, ties by smaller id."""
    scores, ids = np.concatenate([scores, more_scores]), np.concatenate([ids, more_ids])
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top_rows(tree: Tree, anchor, vec_id: int, label: int, floor: int, bounds, k: int):
    """(scores, ids) of the first k rows of the anchor's label in a tile, leaving out those surely below ``floor``."""
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def cut():
        return max(floor, best[0][-1]) if len(best[0]) == k else floor

    def key(low, high):
        return high if high >= cut() else None

    def visit(i):
        scores = (tree.rows[i] @ anchor).astype(np.int64)
        on = np.flatnonzero((scores >= cut()) & (tree.ids[i] != vec_id))
        if len(on):
            best[:] = _merge(*best, scores[on], tree.ids[i][on], k)

    tree.best(*bounds, tree.labels == label, key, visit)
    return best


def window_rows(tree: Tree, anchor, label: int, windows: list[tuple[int, int]], bounds, k: int):
    """Per window (from, to) the (scores, ids) of its first k rows of other labels in a tile."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    cuts = [x for x, _ in windows]

    def key(low, high):
        found = [min(high, to) for (_, to), cut in zip(windows, cuts) if low <= to and min(high, to) >= cut]
        return max(found) if found else None

    def visit(i):
        scores = (tree.rows[i] @ anchor).astype(np.int64)
        for w, (_, to) in enumerate(windows):
            on = np.flatnonzero((scores >= cuts[w]) & (scores <= to))
            if len(on):
                best[w] = _merge(*best[w], scores[on], tree.ids[i][on], k)
                if len(best[w][0]) == k:
                    cuts[w] = max(cuts[w], int(best[w][0][-1]))

    tree.best(*bounds, tree.labels != label, key, visit)
    return best


def _read(column, width: str, d: int, exact: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), width).astype(exact).reshape(-1, d)


def _kinds(largest: int, d: int) -> tuple[str, type]:
    """How components are stored, and computed with: doubles are exact and faster while products stay below 2**53."""
    width = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    return width, np.float64 if 4 * d * largest * largest < 1 << 53 else np.int64


def _pack(rows: DataFrame, parts: int, width: str, d: int, exact: type, s: Settings) -> DataFrame:
    """Leaves (aid null) and anchors (each with its floor) of the tiles."""
    dealt = rows.repartitionByRange(parts, "label", F.element_at("v", 1), F.xxhash64("vec_id", "v"))

    def pack(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        table = pa.concat_tables(tables) if tables else None
        if table is None or not table.num_rows:
            return
        table = table.combine_chunks()
        tile = TaskContext.get().partitionId()
        ids, labels, aid = (table[c].to_numpy() for c in ("vec_id", "label", "aid"))
        whole = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        is_anchor = table["anchor"].to_numpy()
        out = {c.split()[0]: [] for c in _LEAVES.split(", ")}

        def add(*row):
            for column, value in zip(out.values(), row):
                column.append(value)
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            for run in str_pack(whole[mine], s.leaf):
                run = mine[run]
                box = whole[run]
                add(tile, None, ids[run].astype("<i8").tobytes(), int(label), box.astype(width).tobytes(),
                    box.min(0).astype(width).tobytes(), box.max(0).astype(width).tobytes(), None)
            numbers = whole[mine].astype(exact)
            for i in mine[is_anchor[mine]]:
                scores = (numbers @ whole[i].astype(exact)).astype(np.int64)[ids[mine] != ids[i]]
                floor = int(np.partition(scores, -s.positives)[-s.positives]) if len(scores) >= s.positives else None
                add(tile, int(aid[i]), ids[i:i + 1].astype("<i8").tobytes(), int(label),
                    whole[i].astype(width).tobytes(), None, None, floor)
        schema = pa.schema([("tile", pa.int32()), ("aid", pa.int64()), ("vec_id", pa.binary()), ("label", pa.int64()),
                            ("rows", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("floor", pa.int64())])
        for batch in pa.table(out, schema=schema).to_batches(max_chunksize=1024):
            yield batch

    return dealt.mapInArrow(pack, _LEAVES).checkpoint()


def _search(leaves: DataFrame, anchors: DataFrame, tiles: int, n_anchors: int, width: str, d: int, exact: type,
            s: Settings, schema: str, one) -> DataFrame:
    """Every block of anchors against every tile; ``one(tree, anchor row, vector, bounds)`` yields result rows."""
    groups = math.ceil(n_anchors / s.block)
    columns = ["tile", "aid", "vec_id", "label", "rows", "low", "high", "floor", "scores"]
    stored = leaves.withColumn("scores", F.lit(None).cast("array<long>")).select(
        *columns, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    asking = anchors.drop("tile").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select(
        *columns, F.pmod(F.xxhash64("aid"), F.lit(groups)).cast("int").alias("grp"))
    names = [c.split()[0] for c in schema.split(", ")]

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        boxes = table.filter(pa.compute.is_null(table["aid"])).sort_by([("label", "ascending"), ("low", "ascending")])
        asked = table.filter(pa.compute.is_valid(table["aid"]))
        out = []
        if boxes.num_rows and asked.num_rows:
            ids = [np.frombuffer(x, "<i8") for x in boxes["vec_id"].to_pylist()]
            rows = [np.frombuffer(x, width).astype(exact).reshape(-1, d) for x in boxes["rows"].to_pylist()]
            tree = Tree(boxes["label"].to_numpy(), ids, rows, _read(boxes["low"], width, d, exact),
                        _read(boxes["high"], width, d, exact), s.fan)
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                vectors = _read(part["rows"], width, d, exact)
                bounds = tree.bounds(vectors)
                for i, row in enumerate(part.drop_columns(["rows", "low", "high"]).to_pylist()):
                    out += one(tree, row, vectors[i], [b[i] for b in bounds])
        found = list(zip(*out)) if out else [[] for _ in names]
        return pa.table({c: pa.array(list(x), pa.int64()) for c, x in zip(names, found)})

    return stored.unionByName(asking).groupBy("tile", "grp").applyInArrow(search, schema)


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "vector", s: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchor`` holds.

    ``vector_col``: an array of integers.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                     F.col(vector_col).cast("array<long>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
                      & F.forall("v", lambda x: x.isNotNull())).distinct()
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = length["d"] if length else 1
    rows = rows.where(F.size("v") == d).withColumn("aid", F.xxhash64("vec_id", "label", "v"))
    n, n_anchors, largest = rows.agg(F.count(F.lit(1)), F.count_if("anchor"),
                                     F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()  # three numbers
    width, exact = _kinds(largest or 0, d)
    packed = _pack(rows, max(1, math.ceil(n / s.tile)), width, d, exact, s)
    leaves, anchors = packed.where(F.col("aid").isNull()), packed.where(F.col("aid").isNotNull())
    tiles = (packed.agg(F.max("tile")).first()[0] or 0) + 1  # one number
    args = (tiles, max(1, n_anchors), width, d, exact, s)

    def positives(tree, row, vector, bounds):
        floor = _NONE if row["floor"] is None else row["floor"]
        vec_id = int(np.frombuffer(row["vec_id"], "<i8")[0])
        scores, ids = top_rows(tree, vector, vec_id, row["label"], floor, bounds, s.positives)
        return [(row["aid"], vec_id, int(x), int(y)) for x, y in zip(ids, scores)]

    unasked = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    found = _search(leaves, unasked, *args, "aid long, anchor_id long, positive_id long, positive_score long", positives)
    chosen = _first(found, ["aid"], "positive_score", "positive_id", s.positives).drop("rank").checkpoint()

    def negatives(tree, row, vector, bounds):
        windows = [(-(-s.low * p // 100), s.high * p // 100) for p in row["scores"]]
        asked = [(p, w) for p, w in zip(row["scores"], windows) if w[0] <= w[1]]
        best = window_rows(tree, vector, row["label"], [w for _, w in asked], bounds, s.negatives)
        return [(row["aid"], p, int(x), int(y)) for (p, _), (scores, ids) in zip(asked, best) for x, y in zip(ids, scores)]

    asking = anchors.join(chosen.groupBy("aid").agg(F.sort_array(F.collect_set("positive_score")).alias("scores")), "aid")
    found = _search(leaves, asking, *args, "aid long, positive_score long, negative_id long, negative_score long", negatives)
    ranked = _first(found, ["aid", "positive_score"], "negative_score", "negative_id", s.negatives)
    return chosen.join(ranked, ["aid", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
