import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import rtree
from agora.llm.queries import mining_rows
from agora.llm.rtree import Settings

SCHEMA = "vec_id long, label int, vector array<long>"


def plain(rows, step, s=Settings()):
    """All pairs. ``rows``: distinct (id, label, vector) that take part."""
    out = set()
    for a, la, x in rows:
        if a % step:
            continue
        scored = [(sum(i * j for i, j in zip(x, y)), b, lb) for b, lb, y in rows if b != a]
        scored.sort(key=lambda t: (-t[0], t[1]))
        for p, pid, _ in [t for t in scored if t[2] == la][:s.positives]:
            hits = [t for t in scored if t[2] != la and s.low * p <= 100 * t[0] <= s.high * p]
            out |= {(a, pid, r + 1, b, p, n) for r, (n, b, _) in enumerate(hits[:s.negatives])}
    return out


def rows_of(seed, n, d, spread, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (6, d))
    out = []
    for i in range(n):
        c = rng.integers(6)
        v = np.floor(centres[c] + rng.normal(0, spread / 3, d)).astype(int).tolist()
        out.append((i, int(rng.integers(labels)) if i % 3 else int(c % labels), v))
    for i in range(n, n + n // 4):   # copies of a few vectors: ties
        out.append((i, out[i % 5][1] if i % 2 else 1, out[i % 5][2]))
    return out


@pytest.mark.parametrize("seed,n,d,spread,s", [
    (1, 300, 8, 20, Settings(leaf=8, fan=3, tile=64, block=8)),
    (2, 200, 3, 2, Settings(leaf=4, fan=2, tile=50, block=4)),
    (3, 120, 1, 9, Settings(leaf=16, tile=40)),
    (4, 150, 5, 40000, Settings(leaf=16, tile=64, block=5, positives=2, negatives=7)),
    (5, 80, 4, 10**8, Settings(leaf=16, tile=64)),
])
def test_equals_all_pairs(spark, seed, n, d, spread, s):
    rows = rows_of(seed, n, d, spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rtree.mine(df, F.col("vec_id") % 10 == 0, s=s)
    assert {tuple(r) for r in got.collect()} == plain(rows, 10, s)
    assert got.count() == len(plain(rows, 10, s)) > 0


def test_boxes_bound_products_and_prune():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(-5, 5, (200, 4)) + 60 * (i - 2) for i in range(5)])
    parts = rtree.str_pack(rows, 16)
    assert sorted(np.concatenate(parts)) == list(range(1000))
    low, high = np.array([rows[p].min(0) for p in parts]), np.array([rows[p].max(0) for p in parts])
    visits = []
    tree = rtree.Tree(np.zeros(len(parts), int), parts, [rows[p] for p in parts], low, high, 4)
    anchors = rows[[3, 700]]
    bounds = tree.bounds(anchors)
    for k, p in enumerate(parts):
        scores = rows[p] @ anchors.T
        assert (scores.T >= bounds[0][:, [k]]).all() and (scores.T <= bounds[1][:, [k]]).all()
    inner = tree.rows
    tree.rows = type("Seen", (list,), {"__getitem__": lambda self, i: (visits.append(i), inner[i])[1]})()
    scores, ids = rtree.top_rows(tree, anchors[0], -1, 0, rtree._NONE, [b[0] for b in bounds], 5)
    every = rows @ anchors[0]
    want = np.lexsort((np.arange(1000), -every))[:5]
    assert ids.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert len(set(visits)) < len(parts) / 2


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    raw = [(0, 1, [0.5, 0.5]), (7, 0, [0.5, 0.4]), (1, 1, [0.5, 0.49]), (2, 2, [0.3, 0.35]), (3, 2, None), (4, None, [0.3, 0.3]),
           (5, 2, [nan, 0.3]), (6, 2, [inf, 0.3]), (8, 2, [None, 0.3]), (None, 2, [0.3, 0.3]), (9, 2, [0.3]), (10, 2, []),
           (2, 2, [0.3, 0.35]), (50, 3, [0.0, 0.0]), (51, 3, [-0.5, -0.5]), (100, 4, [0.2, 0.2])]
    df = spark.createDataFrame(raw, "vec_id long, label int, embedding array<float>").select(
        "*", F.lit(1).alias("tile"), F.lit("x").alias("anchor"))
    got = {tuple(r) for r in rtree.mine(mining_rows(df), F.col("vec_id") % 50 == 0).collect()}
    part = [(0, 2, [128, 128]), (7, 1, [128, 102]), (1, 1, [128, 125]), (2, 2, [76, 89]), (50, 3, [0, 0]),
            (51, 3, [-128, -128]), (100, 4, [51, 51])]   # 0 and 7 are divisible by 7: the next label
    assert got == plain(part, 50) and got


def test_repeated_ids(spark):
    rows = [(0, 1, [4, 4]), (0, 1, [4, 3]), (1, 1, [4, 4]), (2, 2, [3, 3]), (2, 2, [2, 3]), (2, 2, [3, 3])]
    got = rtree.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert {(r.anchor_id, r.positive_id) for r in got} == {(0, 1)}
    assert {(r.positive_score, r.negative_score, r["rank"]) for r in got} == {(32, 24, 1), (32, 20, 2), (28, 21, 1), (28, 17, 2)}


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = rtree.mine(df, F.col("vec_id") % 50 == 0)
    assert out.count() == 0
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    one = spark.createDataFrame([(0, 1, [1, 2])], SCHEMA)
    assert rtree.mine(one, F.col("vec_id") % 50 == 0).count() == 0
    assert rtree.mine(one, F.lit(False)).count() == 0
