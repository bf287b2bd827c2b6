"""Catalogue: ingestion operators over item tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora import lexicon
from agora.operators import ingest
from agora.plans.registry import query
from agora.sources import tables as T
from agora.sources.tables import with_views

# Caps used by the capped-thread query (parameters).
POST_CAP = 5
CYCLE_CAP = 2000


def _thread_items(spark, sf):
    v = T.v_thread(spark, sf)
    items = v.select("id", "parent", F.lit("comment").alias("type"), "text", "by",
                     "score", "time")
    roots = v.select("story_id", (F.col("story_id") * T.THREAD_STRIDE).alias("root_item_id")).distinct()
    return items, roots


def _expanded(spark, sf, max_depth):
    items, roots = _thread_items(spark, sf)
    return ingest.expand_threads(roots, items, max_depth)


_EXPAND_ALL_SQL = """
WITH RECURSIVE r(story_id, id, depth, path) AS (
  SELECT story_id, id, 0, lpad(CAST(id AS VARCHAR), 19, '0') FROM v_thread
  WHERE parent = story_id * 1048576
  UNION ALL
  SELECT r.story_id, t.id, r.depth + 1, r.path || '/' || lpad(CAST(t.id AS VARCHAR), 19, '0')
  FROM r JOIN v_thread t ON t.parent = r.id)
SELECT story_id, id, CAST(depth AS INTEGER) AS depth, path FROM r"""


@query("thread_expand_all", "J13 without a depth bound", with_views(_EXPAND_ALL_SQL, ["v_thread"]))
def thread_expand_all(spark, sf):
    return _expanded(spark, sf, None).select("story_id", "id", F.col("depth").cast("int"), "path")


_EXPAND_SQL = """
WITH RECURSIVE r(story_id, id, depth, path) AS (
  SELECT story_id, id, 0, lpad(CAST(id AS VARCHAR), 19, '0') FROM v_thread
  WHERE parent = story_id * 1048576
  UNION ALL
  SELECT r.story_id, t.id, r.depth + 1, r.path || '/' || lpad(CAST(t.id AS VARCHAR), 19, '0')
  FROM r JOIN v_thread t ON t.parent = r.id WHERE r.depth + 1 < {d})
SELECT story_id, id, CAST(depth AS INTEGER) AS depth, path FROM r"""


@query("thread_expand", "J13 Q16", with_views(_EXPAND_SQL.format(d=3), ["v_thread"]))
def thread_expand(spark, sf):
    return _expanded(spark, sf, 3).select("story_id", "id", F.col("depth").cast("int"), "path")


@query("thread_expand_depth2", "J13 depth cap", with_views(_EXPAND_SQL.format(d=2), ["v_thread"]))
def thread_expand_depth2(spark, sf):
    return _expanded(spark, sf, 2).select("story_id", "id", F.col("depth").cast("int"), "path")


_CAPPED_SQL = f"""
WITH RECURSIVE r(story_id, id, depth, path) AS (
  SELECT story_id, id, 0, lpad(CAST(id AS VARCHAR), 19, '0') FROM v_thread
  WHERE parent = story_id * 1048576
  UNION ALL
  SELECT r.story_id, t.id, r.depth + 1, r.path || '/' || lpad(CAST(t.id AS VARCHAR), 19, '0')
  FROM r JOIN v_thread t ON t.parent = r.id WHERE r.depth + 1 < 3),
k AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY path) AS rn FROM r),
kk AS (SELECT * FROM k WHERE rn <= {POST_CAP}),
c AS (SELECT story_id, count(*) AS kept FROM kk GROUP BY story_id),
a AS (SELECT story_id, greatest(0, least(kept, {{cycle}} - coalesce(sum(kept) OVER (ORDER BY story_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS allowed FROM c)
SELECT kk.story_id, id, CAST(depth AS INTEGER) AS depth, path, CAST(rn AS INTEGER) AS rn
FROM kk JOIN a USING (story_id) WHERE rn <= allowed"""


def _capped(spark, sf, cycle):
    ex = _expanded(spark, sf, 3)
    order = ex.select("story_id").distinct().withColumn("order_key", F.col("story_id"))
    out = ingest.cap_comments(ex, order, per_post=POST_CAP, per_cycle=cycle)
    return out.select("story_id", "id", F.col("depth").cast("int"), "path",
                      F.col("rn").cast("int"))


@query("thread_capped", "W1 A11 Q8", with_views(_CAPPED_SQL.format(cycle=CYCLE_CAP), ["v_thread"]))
def thread_capped(spark, sf):
    return _capped(spark, sf, CYCLE_CAP)


@query("thread_cycle_capped", "W1 W7 cycle cap", with_views(_CAPPED_SQL.format(cycle=300),
                                                             ["v_thread"]))
def thread_cycle_capped(spark, sf):
    return _capped(spark, sf, 300)


_COMMENTS_SQL = """
WITH RECURSIVE r(story_id, id, depth, path) AS (
  SELECT story_id, id, 0, lpad(CAST(id AS VARCHAR), 19, '0') FROM v_thread
  WHERE parent = story_id * 1048576
  UNION ALL
  SELECT r.story_id, t.id, r.depth + 1, r.path || '/' || lpad(CAST(t.id AS VARCHAR), 19, '0')
  FROM r JOIN v_thread t ON t.parent = r.id)
SELECT 'hackernews' AS platform, CAST(t.id AS VARCHAR) AS external_id, r.story_id,
  CAST(r.depth AS INTEGER) AS depth, t.text AS body,
  CASE WHEN nullif(t."by", '') IS NULL THEN NULL ELSE sha256(t."by") END AS author_hash,
  t.score, t.time AS created_utc, CAST(nullif(t.parent, 0) AS VARCHAR) AS parent_comment_id,
  'https://news.ycombinator.com/item?id=' || CAST(t.id AS VARCHAR) AS permalink
FROM r JOIN v_thread t USING (id)
WHERE t.text IS NOT NULL AND NOT regexp_matches(t.text, '^[\\s\\p{Z}]*$')"""


@query("ingest_comments", "P6 P8 P9 P11 P12 S8", with_views(_COMMENTS_SQL, ["v_thread"]))
def ingest_comments(spark, sf):
    items, roots = _thread_items(spark, sf)
    return _comments(items, roots)


def _comments(items, roots):
    out = ingest.to_comments(items, ingest.expand_threads(roots, items))
    return out.select("platform", "external_id", "story_id", F.col("depth").cast("int"),
                      "body", "author_hash", "score", "created_utc", "parent_comment_id",
                      "permalink")


@query("ingest_metrics", "A8 S5 P6", with_views(f"""
WITH RECURSIVE r(story_id, id, depth, path) AS (
  SELECT story_id, id, 0, lpad(CAST(id AS VARCHAR), 19, '0') FROM v_thread
  WHERE parent = story_id * 1048576
  UNION ALL
  SELECT r.story_id, t.id, r.depth + 1, r.path || '/' || lpad(CAST(t.id AS VARCHAR), 19, '0')
  FROM r JOIN v_thread t ON t.parent = r.id),
g AS (SELECT r.story_id, r.path, {{good}} AS good FROM r JOIN v_thread t USING (id)),
k AS (SELECT *, row_number() OVER (PARTITION BY story_id, good ORDER BY path) AS rn FROM g)
SELECT count(DISTINCT story_id) AS stories_fetched,
  count(DISTINCT story_id) FILTER (WHERE good AND rn <= {POST_CAP}) AS stories_ingested,
  count(*) FILTER (WHERE good AND rn <= {POST_CAP}) AS comments_added,
  count(*) FILTER (WHERE NOT good) AS comments_skipped,
  count(*) FILTER (WHERE good AND rn > {POST_CAP}) > 0 AS cap_reached
FROM k""".format(good="(t.id % 13 <> 0 AND t.text IS NOT NULL AND NOT regexp_matches(t.text, '^[\\s\\p{Z}]*$'))"),
    ["v_thread"]))
def ingest_metrics(spark, sf):
    """Every 13th item is marked deleted; blank and deleted items are skipped and use no slot of the cap."""
    items, roots = _thread_items(spark, sf)
    items = items.withColumn("deleted", F.col("id") % 13 == 0).withColumn("dead", F.lit(False))
    ex = ingest.expand_threads(roots, items)
    order = ex.select("story_id").distinct().withColumn("order_key", F.col("story_id"))
    stored = ingest.cap_comments(ingest.storable(ex, ingest.live_items(items)), order, per_post=POST_CAP)
    return ingest.ingest_counts(ex.select("story_id", F.col("id").alias("item_id")), items, stored)


EVENT_STORY_TYPE = {"view": "top", "click": "ask", "purchase": "show", "signup": "new"}


def _ranked_lists(spark, sf):
    """Ranked story-id lists from events: per story type, users in order of
    their first event (ties by id); position 0-based."""
    ev = T.table(spark, sf, "events")
    typ = T._case(F.col("event_type"), EVENT_STORY_TYPE)
    firsts = (ev.select(typ.alias("story_type"), F.col("user_id").alias("item_id"), "ts")
              .where(F.col("story_type").isNotNull())
              .groupBy("story_type", "item_id").agg(F.min("ts").alias("first_ts")))
    from pyspark.sql import Window
    w = Window.partitionBy("story_type").orderBy("first_ts", "item_id")
    return firsts.select("story_type", "item_id",
                         (F.row_number().over(w) - 1).alias("pos"))


_CANDIDATES_SQL = """
WITH f AS (SELECT CASE event_type WHEN 'view' THEN 'top' WHEN 'click' THEN 'ask'
                  WHEN 'purchase' THEN 'show' WHEN 'signup' THEN 'new' END AS story_type,
                  user_id AS item_id, min(ts) AS first_ts
           FROM events GROUP BY ALL),
r AS (SELECT story_type, item_id, row_number() OVER (PARTITION BY story_type ORDER BY first_ts, item_id) - 1 AS pos
      FROM f WHERE story_type IS NOT NULL),
c AS (SELECT *, CAST(list_position(['top', 'ask', 'show'], story_type) - 1 AS INTEGER) AS type_rank
      FROM r WHERE story_type IN ('top', 'ask', 'show') AND {cut})
SELECT item_id, arg_min(story_type, CAST(type_rank AS BIGINT) * 1099511627776 + pos) AS story_type,
  arg_min(pos, CAST(type_rank AS BIGINT) * 1099511627776 + pos) AS pos,
  arg_min(type_rank, CAST(type_rank AS BIGINT) * 1099511627776 + pos) AS type_rank,
  min(CAST(type_rank AS BIGINT) * 1099511627776 + pos) AS order_key
FROM c GROUP BY item_id"""


def _candidates(spark, sf, per_type):
    c = ingest.story_candidates(_ranked_lists(spark, sf), per_type=per_type)
    return c.select("item_id", "story_type", "pos", "type_rank", "order_key")


@query("story_candidates", "S2 S3 S4 U1 W7, first 100 of each type",
       with_views(_CANDIDATES_SQL.format(cut="pos < 100"), []))
def story_candidates(spark, sf):
    return _candidates(spark, sf, lexicon.CANDIDATES_PER_TYPE)


@query("story_candidates_all", "S2 S3 S4 U1 W7", with_views(_CANDIDATES_SQL.format(cut="true"), []))
def story_candidates_all(spark, sf):
    return _candidates(spark, sf, None)


def _batches(spark, sf):
    c = T.v_comment(spark, sf)
    first = c.select(F.lit("hackernews").alias("platform"), "external_id", "body", "score",
                     F.lit(1).alias("ingested_at"))
    again = (c.where(F.col("lang") == "en")
             .select(F.lit("hackernews").alias("platform"), "external_id", "body",
                     (F.col("score") + 1).alias("score"), F.lit(2).alias("ingested_at")))
    return first.unionByName(again)


@query("dedup_latest", "U4 W5 T2", with_views("""
WITH b AS (
  SELECT 'hackernews' AS platform, external_id, body, score, 1 AS ingested_at FROM v_comment
  UNION ALL
  SELECT 'hackernews', external_id, body, score + 1, 2 FROM v_comment WHERE lang = 'en')
SELECT platform, external_id, body, score, ingested_at FROM (
  SELECT *, row_number() OVER (PARTITION BY platform, external_id ORDER BY ingested_at DESC) AS rn FROM b)
WHERE rn = 1""", ["v_comment"]))
def dedup_latest(spark, sf):
    return ingest.dedup_latest(_batches(spark, sf)).select(
        "platform", "external_id", "body", "score", "ingested_at")


@query("upsert_merge", "S7 S8 J14 Q15 P6", with_views("""
WITH e AS (SELECT external_id, body, score, lang FROM v_comment WHERE lang IN ('en', 'de')),
i AS (SELECT external_id, upper(body) AS body, score + 7 AS score, lang FROM v_comment
      WHERE lang IN ('en', 'fr', 'es')
        AND body IS NOT NULL AND NOT regexp_matches(body, '^[\\s\\p{Z}]*$'))
SELECT coalesce(e.external_id, i.external_id) AS external_id,
  CASE WHEN e.external_id IS NOT NULL THEN e.body ELSE i.body END AS body,
  coalesce(i.score, e.score) AS score,
  CASE WHEN e.external_id IS NOT NULL THEN e.lang ELSE i.lang END AS lang,
  CASE WHEN e.external_id IS NULL THEN 'inserted' WHEN i.external_id IS NULL THEN 'kept'
       ELSE 'updated' END AS merge_status
FROM e FULL OUTER JOIN i ON e.external_id = i.external_id""", ["v_comment"]))
def upsert_merge(spark, sf):
    from agora.functions.text import is_blank
    c = T.v_comment(spark, sf)
    existing = c.where(F.col("lang").isin("en", "de")).select("external_id", "body", "score", "lang")
    incoming = (c.where(F.col("lang").isin("en", "fr", "es") & ~is_blank(F.col("body")))
                .select("external_id", F.upper("body").alias("body"),
                        (F.col("score") + 7).alias("score"), "lang"))
    return ingest.upsert(existing, incoming, "external_id", refresh=["score"])
