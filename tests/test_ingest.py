from pyspark.sql import functions as F

from agora.operators import ingest

ISCHEMA = "id long, parent long, type string, text string, by string, score int, time long"


def _items(spark, rows):
    return spark.createDataFrame(rows, ISCHEMA)


def _roots(spark, story=1001):
    return spark.createDataFrame([(story, story)], "story_id long, root_item_id long")


def test_expand_depth_cap(spark):
    items = _items(spark, [(1, 1001, "comment", "kid", "a", 1, 1), (2, 1, "comment", "grandkid", "b", 1, 2)])
    ex = ingest.expand_threads(_roots(spark), items, max_depth=1)
    assert [r.id for r in ex.collect()] == [1]
    ex3 = ingest.expand_threads(_roots(spark), items, max_depth=3)
    assert sorted(r.id for r in ex3.collect()) == [1, 2]


def test_missing_kids_and_blank(spark):
    # kid 2 is blank: not stored, but its child is still visited
    items = _items(spark, [(2, 1001, "comment", "   ", "a", 0, 1), (3, 2, "comment", "reply", "b", 0, 2)])
    ex = ingest.expand_threads(_roots(spark), items, 3)
    com = ingest.to_comments(items, ex).collect()
    assert [r.external_id for r in com] == ["3"]
    assert com[0].parent_comment_id == "2"


def test_non_comment_children_not_visited(spark):
    items = _items(spark, [(2, 1001, "job", "x", "a", 0, 1), (3, 2, "comment", "reply", "b", 0, 2)])
    ex = ingest.expand_threads(_roots(spark), items, 3)
    assert ingest.to_comments(items, ex).count() == 0


def test_caps_strict(spark):
    items = _items(spark, [(i, 1001, "comment", f"c{i}", "u", 0, i) for i in range(1, 4)])
    ex = ingest.expand_threads(_roots(spark), items, 3)
    order = spark.createDataFrame([(1001, 0)], "story_id long, order_key long")
    assert ingest.cap_comments(ex, order, per_post=2).count() <= 2
    assert ingest.cap_comments(ex, order, per_post=10, per_cycle=2).count() <= 2


def test_cycle_cap_across_stories(spark):
    rows = [(100 * s + i, 100 * s, "comment", "t", "u", 0, 0) for s in (1, 2, 3) for i in range(1, 4)]
    items = _items(spark, rows)
    roots = spark.createDataFrame([(100 * s, 100 * s) for s in (1, 2, 3)], "story_id long, root_item_id long")
    ex = ingest.expand_threads(roots, items, 3)
    order = spark.createDataFrame([(100 * s, s) for s in (1, 2, 3)], "story_id long, order_key long")
    kept = ingest.cap_comments(ex, order, per_post=10, per_cycle=5).groupBy("story_id").count()
    assert {r.story_id: r["count"] for r in kept.collect()} == {100: 3, 200: 2}


def test_same_item_twice_is_one_row(spark):
    rows = spark.createDataFrame([("hackernews", "7", 1, 1), ("hackernews", "7", 5, 2)],
                                 "platform string, external_id string, score int, ingested_at int")
    out = ingest.dedup_latest(rows).collect()
    assert len(out) == 1 and out[0].score == 5


def test_upsert_refreshes_only_listed_columns(spark):
    existing = spark.createDataFrame([("1", "old body", 1)], "external_id string, body string, score int")
    incoming = spark.createDataFrame([("1", "new body", 9), ("2", "b2", 3)],
                                     "external_id string, body string, score int")
    got = {r.external_id: (r.body, r.score, r.merge_status)
           for r in ingest.upsert(existing, incoming, "external_id", ["score"]).collect()}
    assert got == {"1": ("old body", 9, "updated"), "2": ("b2", 3, "inserted")}


def test_story_candidates_toggles_and_first_position(spark):
    ranked = spark.createDataFrame([("top", 0, 10), ("ask", 0, 10), ("ask", 1, 11), ("show", 0, 12),
                                    ("new", 0, 13)], "story_type string, pos long, item_id long")
    c = {r.item_id: r.story_type for r in ingest.story_candidates(ranked).collect()}
    assert c == {10: "top", 11: "ask", 12: "show"}
    only_ask = ingest.story_candidates(ranked, types=["ask"]).collect()
    assert sorted(r.item_id for r in only_ask) == [10, 11]
    assert ingest.story_candidates(ranked, types=[]).count() == 0


def test_activity_gate(spark):
    s = spark.createDataFrame([("OpenAI ships a thing", 10), ("OpenAI ships a thing", 150)],
                              "title string, descendants int")
    assert ingest.story_filter(s, min_comments=100).count() == 1


def test_topic_names_collision(spark):
    s = spark.createDataFrame([(1, "Same"), (2, "Same"), (3, "Other")], "story_id long, title string")
    got = {r.story_id: r.name for r in ingest.topic_names(s).collect()}
    assert got == {1: "Same", 2: "Same (#2)", 3: "Other"}


def test_ranked_lists(spark):
    lists = spark.createDataFrame([("top", [5, 6])], "story_type string, ids array<long>")
    assert [(r.pos, r.item_id) for r in ingest.ranked_lists(lists).orderBy("pos").collect()] == [(0, 5), (1, 6)]


def test_live_items(spark):
    df = spark.createDataFrame([(1, True, None), (2, None, None), (3, False, True)],
                               "id long, deleted boolean, dead boolean")
    assert [r.id for r in ingest.live_items(df).collect()] == [2]
