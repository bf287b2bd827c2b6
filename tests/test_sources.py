"""Scans, lookups and sinks on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from agora.operators import cluster, embed, evaluate, ingest, reports
from agora.sources import sinks


def test_item_dump_and_live_items(spark, tmp_path):
    rows = [{"id": 1, "type": "comment", "text": "a", "kids": [2]}, {"id": 2, "deleted": True}, {"id": 3, "dead": True, "odd": 1}]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, rows)))
    items = ingest.read_items(spark, str(tmp_path / "items.json"))
    assert items.schema == ingest.ITEM_SCHEMA and items.count() == 3
    assert [r.id for r in ingest.live_items(items).collect()] == [1]


def test_lookup_keeps_order_and_misses(spark):
    items = spark.createDataFrame([(5, "five"), (7, "seven")], "id long, title string")
    ids = spark.createDataFrame([(1, [7, 9, 5])], "request_id long, ids array<long>")
    assert [(r.pos, r.id, r.title) for r in ingest.lookup_ordered(ids, items).collect()] == [
        (0, 7, "seven"), (1, 9, None), (2, 5, "five")]


def test_posts_have_defaults(spark):
    stories = spark.createDataFrame([(1, "OpenAI ships Rust tools", None, "pg", None, 5), (2, None, "t", None, 3, None)],
                                    "id long, title string, text string, by string, score int, time long")
    a, b = ingest.to_posts(stories).orderBy("external_id").collect()
    assert (a.selftext, a.score, a.created_utc, a.target_terms) == ("", 0, 5, "OpenAI,Rust")
    assert (b.title, b.author_hash, b.created_utc, b.target_terms) == ("", None, 0, "")


def test_upsert_on_two_keys(spark):
    schema = "platform string, external_id string, body string, score int"
    old = spark.createDataFrame([("a", "1", "x", 1), ("b", "1", "y", 2)], schema)
    new = spark.createDataFrame([("b", "1", "z", 9), ("b", "2", "n", 4)], schema)
    got = {(r.platform, r.external_id): (r.body, r.score, r.merge_status)
           for r in ingest.upsert(old, new, ["platform", "external_id"], ["score"]).collect()}
    assert got == {("a", "1"): ("x", 1, "kept"), ("b", "1"): ("y", 9, "updated"), ("b", "2"): ("n", 4, "inserted")}


def test_caps_count_stored_comments_only(spark):
    items = spark.createDataFrame([(1, 100, "comment", "a"), (2, 100, "comment", " "), (3, 100, "poll", "p"), (4, 100, "comment", "b"),
                                   (5, 100, "comment", "c")], "id long, parent long, type string, text string")
    roots = spark.createDataFrame([(100, 100)], "story_id long, root_item_id long")
    order = spark.createDataFrame([(100, 0)], "story_id long, order_key long")
    ex = ingest.expand_threads(roots, items)
    stored = ingest.cap_comments(ingest.storable(ex, items), order, per_post=2)
    assert sorted(r.id for r in stored.collect()) == [1, 4]
    assert ingest.cap_comments(ex, order).count() == 5
    counts = ingest.ingest_counts(ex.select("story_id", F.col("id").alias("item_id")), items, stored).first()
    assert tuple(counts) == (1, 1, 2, 2, True)


def test_replace_clusters(spark):
    schema = "topic_id long, stance string, size int"
    old = spark.createDataFrame([(1, "A", 3), (1, "B", 4), (2, "A", 5)], schema)
    new = spark.createDataFrame([(1, "A", 9)], schema)
    topics = spark.createDataFrame([(1,)], "topic_id long")
    assert sorted(map(tuple, cluster.replace_clusters(old, new, topics).collect())) == [(1, "A", 9), (2, "A", 5)]


def test_normalised_kmeans_ignores_length(spark):
    rows = [(1, "A", i, [float(s * (i + 1)), 0.0] if i % 2 else [0.0, float(i + 1)]) for i, s in enumerate([1] * 8)]
    points = spark.createDataFrame(rows, "topic_id long, stance string, comment_id long, embedding array<double>")
    _, assigned = cluster.kmeans(points, k=2, normalize=True)
    by = {}
    for r in assigned.collect():
        by.setdefault(r.cluster, set()).add(r.comment_id % 2)
    assert sorted(map(sorted, by.values())) == [[0], [1]]


def test_topic_by_id(spark):
    topics = spark.createDataFrame([(1, "a"), (2, "b")], "topic_id long, name string")
    assert [r.name for r in reports.topic_by_id(topics, 2).collect()] == ["b"]
    assert reports.topic_by_id(topics, 3).count() == 0


def test_vectors_as_json(spark):
    df = spark.createDataFrame([(1, "[1.0, 2.5]"), (2, "no"), (3, None)], "comment_id long, embedding_vector string")
    parsed = embed.vectors_from_json(df)
    assert [(r.comment_id, r.embedding) for r in parsed.collect()] == [(1, [1.0, 2.5])]
    assert json.loads(embed.vectors_to_json(parsed.drop("embedding_vector")).first().embedding_vector) == [1.0, 2.5]


def test_embed_counts(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, False)], "comment_id long, is_zero boolean")
    assert tuple(embed.embed_counts(df).first()) == (2, 1)


def test_labelling_sheet_round_trip(spark, tmp_path):
    row = (1, "e1", 2, 3, "Rust", 'say "hi",\nnow', "SUPPORT", "", "2", "")
    sheet = spark.createDataFrame([row], "id long, external_id string, topic_id long, post_id long, target_terms string, "
                                         "body string, stance string, sentiment string, toxicity string, notes string")
    sinks.write_labelling_csv(sheet, str(tmp_path / "sheet"))
    back = evaluate.read_labelled_csv(spark, str(tmp_path / "sheet"))
    assert back.columns == evaluate.LABEL_COLUMNS and back.first().body == row[5]
    assert tuple(evaluate.labelled_counts(back).first()) == (1, 0, 1)
    sheet.drop("stance").write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="stance"):
        evaluate.read_labelled_csv(spark, str(tmp_path / "bad"))


def test_nested_report_and_tables(spark, tmp_path):
    pairs = spark.createDataFrame([("s", "A", "A"), ("s", "B", "A"), ("t", "X", "X")], "task string, y_true string, y_pred string")
    report = evaluate.classification_reports(pairs)
    nested = {r.task: (r.n_evaluated, r.metrics["accuracy"].precision) for r in evaluate.nested_report(report).collect()}
    assert nested == {"s": (2, 0.5), "t": (1, 1.0)}
    sinks.write_report_json(evaluate.nested_report(report), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    sinks.write_table(report, str(tmp_path / "table"), ["task"])
    assert spark.read.parquet(str(tmp_path / "table")).where("task = 's'").count() == report.where("task = 's'").count()
