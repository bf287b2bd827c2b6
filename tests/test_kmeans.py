"""Sampled seeding and bounded assignment against plain numpy versions."""

import numpy as np
import pytest

from agora.operators import cluster as CL
from agora.operators import kmeans as KM

VSCHEMA = "topic_id long, stance string, comment_id long, embedding array<float>, body string"


def _frame(spark, groups):
    rows = [(t, s, i, None if v is None else [None if x is None else float(x) for x in v], "b")
            for (t, s), vecs in groups.items() for i, v in vecs]
    return spark.createDataFrame(rows, VSCHEMA)


def _plain(x, centres, steps):
    """Lloyd steps with all distances; a centre without points stays."""
    centres = centres.copy()
    for _ in range(steps):
        a = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for j in np.unique(a):
            centres[j] = x[a == j].mean(0)
    return ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)


def _blobs(seed, n, dims=6, spread=0.6):
    rng = np.random.default_rng(seed)
    return np.float32(rng.normal(0, 3, (5, dims))[rng.integers(0, 5, n)] + rng.normal(0, spread, (n, dims)))


def test_bounds_equal_plain_assignment_while_centres_move():
    rng = np.random.default_rng(3)
    x, centres = _blobs(1, 500).astype(float), rng.normal(0, 3, (7, 6))
    a = u = low = None
    work, moves = [], np.zeros(7)
    for _ in range(15):
        a, u, low, n = KM.settle(x, centres, moves, a, u, low)
        dist = ((x[:, None] - centres[None]) ** 2).sum(-1)
        assert (a == dist.argmin(1)).all()
        assert (u + 1e-9 >= np.sqrt(dist.min(1))).all()
        work.append(n)
        new = np.array([x[a == j].mean(0) if (a == j).any() else centres[j] for j in range(7)])
        moves, centres = np.sqrt(((new - centres) ** 2).sum(1)), new
    assert work[0] == 500 and work[-1] < 50


def test_ties_go_to_the_lower_cluster():
    x, centres = np.array([[0.0], [1.0], [-1.0]]), np.array([[1.0], [-1.0]])
    a, u, low, _ = KM.settle(x, centres, np.zeros(2), None, None, None)
    again = KM.settle(x, centres, np.zeros(2), a, u, low)[0]
    assert a.tolist() == again.tolist() == [0, 0, 1]


@pytest.mark.parametrize("steps", [1, 6])
def test_blocks_equal_plain_lloyd(spark, steps):
    groups = {(1, "SUPPORT"): list(enumerate(_blobs(1, 130))), (2, "OPPOSE"): list(enumerate(_blobs(2, 40)))}
    packed = KM.blocks(KM.usable(CL.prepare(_frame(spark, groups))), size=16)
    assert packed.count() > 10
    start = {g: np.array([v for _, v in vecs[:4]], dtype=float) for g, vecs in groups.items()}
    seeds = spark.createDataFrame([(*g, j, [float(x) for x in c]) for g, cs in start.items() for j, c in enumerate(cs)],
                                  "topic_id long, stance string, cluster int, vec array<double>")
    _, assigned, work = KM.lloyd(packed, seeds, steps, 1e-9)
    got = {(r.topic_id, r.stance, r.comment_id): r.cluster for r in assigned.collect()}
    for g, vecs in groups.items():
        want = _plain(np.array([v for _, v in vecs], dtype=float), start[g], steps)
        assert [got[(*g, i)] for i, _ in vecs] == want.tolist()
    done = [sum(r.computed for r in w.collect()) for w in work]
    assert done[0] == 170 and (steps == 1 or done[-1] < 170)


def test_sampled_seeds_reach_every_group_and_are_stable(spark):
    rng = np.random.default_rng(5)
    vecs = np.vstack([c + rng.normal(0, 0.1, (n, 8)) for c, n in zip(np.eye(8)[:5] * 9, (400, 200, 20, 3, 3))])
    frame = _frame(spark, {(1, "SUPPORT"): list(enumerate(vecs))})
    one = {r.comment_id: r.cluster for r in CL.kmeans(frame, k=5)[1].collect()}
    clusters, assigned = CL.kmeans(frame.repartition(3), k=5)
    assert sorted(r["size"] for r in clusters.collect()) == [3, 3, 20, 200, 400]
    assert {r.comment_id: r.cluster for r in assigned.collect()} == one


def test_vectors_do_not_move_between_steps(spark):
    packed = KM.blocks(KM.usable(CL.prepare(_frame(spark, {(1, "SUPPORT"): list(enumerate(_blobs(1, 60)))}))), size=8)
    state = packed.select(*KM.KEY).limit(100).checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = packed.join(state, KM.KEY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    head = plan.split("InMemoryRelation")[0]
    assert head.count("Exchange hashpartitioning") <= 1, plan


def test_odd_rows(spark):
    bad = [(7, None), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 0.0])]
    frame = _frame(spark, {(1, "SUPPORT"): [(0, [1, 0]), (1, [1, 0]), (2, [0, 1]), *bad], (1, "OPPOSE"): [(20, [1, 1])],
                           (None, "SUPPORT"): [(30, [1, 1]), (31, [2, 1])]})
    clusters, assigned = CL.kmeans(frame, k=10)
    assert sorted(r["size"] for r in clusters.collect()) == [1, 2]
    assert sorted(r.comment_id for r in assigned.collect()) == [0, 1, 2]
    none, nobody = CL.kmeans(frame.limit(0), k=3)
    assert none.count() == nobody.count() == 0
    same, _ = CL.kmeans(_frame(spark, {(1, "SUPPORT"): [(i, [2, 2]) for i in range(50)]}), k=4)
    assert [r["size"] for r in same.collect()] == [50]
