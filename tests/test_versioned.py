"""Stored tables that change by whole commits."""

import pytest

from agora.sources import versioned as V

SCHEMA = "id long, body string, score int, at long"


def make(spark, tmp_path, buckets=8):
    return V.Tables(spark, str(tmp_path / "store"), {"c": SCHEMA}, {"c": ["id"]}, buckets)


def put(spark, tables, version, rows):
    return V.upsert(tables, version, "c", spark.createDataFrame(rows, SCHEMA), ["score"], "at")


def rows_of(tables):
    return sorted(tuple(r) for r in tables.read("c").collect())


def test_same_id_twice_is_one_row_with_the_newer_score(spark, tmp_path):
    t = make(spark, tmp_path)
    assert rows_of(t) == [] and t.state()[0] == -1
    assert put(spark, t, 0, [(1, "a", 1, 10), (2, "b", 1, 10), (1, "a2", 5, 11)])
    assert rows_of(t) == [(1, "a2", 5, 11), (2, "b", 1, 10)]
    assert put(spark, t, 1, [(2, "changed", 7, 12), (3, "c", 0, 12), (1, "old", 99, 3)])
    assert rows_of(t) == [(1, "a2", 5, 11), (2, "b", 7, 12), (3, "c", 0, 12)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = make(spark, tmp_path)
    put(spark, t, 4, [(1, "a", 1, 10)])
    assert not put(spark, t, 4, [(1, "a", 50, 11), (9, "z", 0, 11)])
    assert not put(spark, t, 3, [(9, "z", 0, 11)])
    assert rows_of(t) == [(1, "a", 1, 10)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = make(spark, tmp_path)
    put(spark, t, 0, [(i, "x", 0, 1) for i in range(200)])
    before = t.state()[1]
    put(spark, t, 1, [(5, "x", 3, 2)])
    after = t.state()[1]
    assert len(before) == 8 and sum(after[k] == 1 for k in after) == 1 and set(after) == set(before)
    assert len(rows_of(t)) == 200 and [r for r in rows_of(t) if r[2]] == [(5, "x", 3, 2)]


def test_a_failure_before_the_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    t = make(spark, tmp_path)
    put(spark, t, 0, [(i, "x", 0, 1) for i in range(20)])
    old = rows_of(t)

    def fails(self, version, held):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(V.Tables, "_point", fails)
        with pytest.raises(RuntimeError):
            put(spark, t, 1, [(3, "x", 9, 2), (77, "new", 1, 2)])
    assert rows_of(t) == old and t.state()[0] == 0
    assert put(spark, t, 1, [(3, "x", 9, 2), (77, "new", 1, 2)])   # the retry writes the same version again
    assert (3, "x", 9, 2) in rows_of(t) and (77, "new", 1, 2) in rows_of(t) and len(rows_of(t)) == 21


def test_empty_batches_and_long_streams(spark, tmp_path):
    t = make(spark, tmp_path)
    assert put(spark, t, 0, [])
    assert t.state() == (0, {}) and rows_of(t) == []
    for i, parts in enumerate([[(1, "a", 1, 1)], [(1, "a", 2, 2), (2, "b", 1, 2)]]):
        spark.createDataFrame(parts, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        u = V.Tables(spark, str(tmp_path / "other"), {"c": SCHEMA}, {"c": ["id"]}, 4)
        V.upsert_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), u, "c", ["score"], "at", f"{tmp_path}/ck")
    assert rows_of(u) == [(1, "a", 2, 2), (2, "b", 1, 2)] and u.state()[0] == 1


CLUSTERS = "topic_id long, stance string, cluster int, size long"
ASSIGNED = "topic_id long, comment_id long, stance string, cluster int"


def test_clusters_and_assignments_change_together(spark, tmp_path, monkeypatch):
    t = V.Tables(spark, str(tmp_path), {"clusters": CLUSTERS, "assignments": ASSIGNED},
                 {"clusters": ["topic_id"], "assignments": ["topic_id"]}, 4)
    topics = lambda *x: spark.createDataFrame([(i,) for i in x], "topic_id long")
    c = spark.createDataFrame([(1, "SUPPORT", 0, 2), (1, "OPPOSE", 0, 1), (2, "MIXED", 0, 1)], CLUSTERS)
    a = spark.createDataFrame([(1, 10, "SUPPORT", 0), (1, 11, "SUPPORT", 0), (1, 12, "OPPOSE", 0), (2, 20, "MIXED", 0)], ASSIGNED)
    assert V.replace_clusters(t, 0, topics(1, 2), c, a)
    new_c = spark.createDataFrame([(1, "SUPPORT", 1, 2)], CLUSTERS)
    new_a = spark.createDataFrame([(1, 10, "SUPPORT", 1), (1, 13, "SUPPORT", 1)], ASSIGNED)
    read = lambda: (sorted(tuple(r) for r in t.read("clusters").collect()),
                    sorted(tuple(r) for r in t.read("assignments").collect()))
    old = read()
    with monkeypatch.context() as m:
        m.setattr(V.Tables, "_point", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            V.replace_clusters(t, 1, topics(1), new_c, new_a)
    assert read() == old
    assert V.replace_clusters(t, 1, topics(1), new_c, new_a)
    clusters, assigned = t.read("clusters").collect(), {tuple(r) for r in t.read("assignments").collect()}
    assert {tuple(r) for r in clusters} == {(1, "SUPPORT", 1, 2), (2, "MIXED", 0, 1)}
    assert assigned == {(1, 10, "SUPPORT", 1), (1, 11, None, None), (1, 12, None, None), (1, 13, "SUPPORT", 1), (2, 20, "MIXED", 0)}


def test_a_topic_whose_clusters_all_go(spark, tmp_path):
    t = V.Tables(spark, str(tmp_path), {"clusters": CLUSTERS, "assignments": ASSIGNED},
                 {"clusters": ["topic_id"], "assignments": ["topic_id"]}, 4)
    topic = spark.createDataFrame([(1,)], "topic_id long")
    V.replace_clusters(t, 0, topic, spark.createDataFrame([(1, "MIXED", 0, 1)], CLUSTERS),
                       spark.createDataFrame([(1, 5, "MIXED", 0)], ASSIGNED))
    V.replace_clusters(t, 1, topic, spark.createDataFrame([], CLUSTERS), spark.createDataFrame([], ASSIGNED))
    assert t.read("clusters").count() == 0
    assert [tuple(r) for r in t.read("assignments").collect()] == [(1, 5, None, None)]
