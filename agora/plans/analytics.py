"""Catalogue: rollups and report queries over classified comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions.scalar import day_label, half_up, iso_utc, percent, round6
from agora.operators import paging, reports, rollup
from agora.plans.registry import query
from agora.sources import tables as T
from agora.sources.tables import with_views

_STANCE_SUMS = """
  CAST(sum(CASE WHEN stance = 'SUPPORT' THEN cnt ELSE 0 END) AS BIGINT) AS stance_support_count,
  CAST(sum(CASE WHEN stance = 'OPPOSE' THEN cnt ELSE 0 END) AS BIGINT) AS stance_oppose_count,
  CAST(sum(CASE WHEN stance = 'MIXED' THEN cnt ELSE 0 END) AS BIGINT) AS stance_mixed_count,
  CAST(sum(CASE WHEN stance = 'NEUTRAL' THEN cnt ELSE 0 END) AS BIGINT) AS stance_neutral_count,
  CAST(sum(cnt) AS BIGINT) AS total_comments,
  floor(list_reduce(list(CAST(units AS DOUBLE) / scored * cnt ORDER BY stance) FILTER (scored > 0), lambda a, b: a + b)
        / sum(CASE WHEN scored > 0 THEN cnt END) / 1e9 * 1e6 + 0.5) / 1e6 AS avg_toxicity"""

_STANCE_PARTS = "count(*) AS cnt, sum(CAST(round(toxicity * 1e9) AS BIGINT)) AS units, count(toxicity) AS scored"

_DAILY_SQL = f"""
WITH g AS (
  SELECT topic_id, CAST(epoch_ms(created_utc * 1000) AS DATE) AS date, stance,
         {_STANCE_PARTS}
  FROM v_classified GROUP BY ALL)
SELECT topic_id, date, {_STANCE_SUMS}
FROM g GROUP BY topic_id, date"""


def _daily(spark, sf):
    d = rollup.daily_stats(T.v_classified(spark, sf))
    return d.withColumn("avg_toxicity", half_up(F.col("avg_toxicity"), 6))


@query("daily_stats", "J4 A1 Q1 Q2 Q17", with_views(_DAILY_SQL, ["v_classified"]))
def daily_stats(spark, sf):
    return _daily(spark, sf)


@query("timeline", "A1 P14 K6 Q2 Q3", with_views(f"""
WITH d AS ({_DAILY_SQL})
SELECT *,
  round(coalesce(stance_support_count / nullif(stance_support_count + stance_oppose_count + stance_mixed_count + stance_neutral_count, 0), 0), 6) AS support_pct,
  round(coalesce(stance_oppose_count / nullif(stance_support_count + stance_oppose_count + stance_mixed_count + stance_neutral_count, 0), 0), 6) AS oppose_pct,
  round(coalesce(stance_mixed_count / nullif(stance_support_count + stance_oppose_count + stance_mixed_count + stance_neutral_count, 0), 0), 6) AS mixed_pct,
  round(coalesce(stance_neutral_count / nullif(stance_support_count + stance_oppose_count + stance_mixed_count + stance_neutral_count, 0), 0), 6) AS neutral_pct
FROM d WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
ORDER BY topic_id, date""", ["v_classified"]))
def timeline(spark, sf):
    t = reports.timeline(_daily(spark, sf), date_from="2024-01-03", date_to="2024-01-20")
    return t.select(*[round6(F.col(c)).alias(c) if c.endswith("_pct") else F.col(c)
                      for c in t.columns])


_SIX_HOURS_SQL = f"""
WITH src AS (SELECT * FROM v_classified{{recent}}),
g AS (
  SELECT topic_id, time_bucket(INTERVAL 6 HOUR, epoch_ms(created_utc * 1000)) AS bucket_start,
         stance, {_STANCE_PARTS}
  FROM src GROUP BY ALL)
SELECT topic_id, bucket_start, {_STANCE_SUMS}
FROM g GROUP BY topic_id, bucket_start"""


def _six_hours(spark, sf, history_days):
    d = rollup.windowed_stats(T.v_classified(spark, sf), "6 hours", history_days=history_days)
    return d.withColumn("avg_toxicity", half_up(F.col("avg_toxicity"), 6))


@query("timeline_6h", "E1 T4 A1, last 30 days", with_views(_SIX_HOURS_SQL.format(
    recent=" WHERE created_utc >= (SELECT max(created_utc) FROM v_classified) - 30 * 86400"), ["v_classified"]))
def timeline_6h(spark, sf):
    return _six_hours(spark, sf, 30)


@query("timeline_6h_all", "E1 T4 A1", with_views(_SIX_HOURS_SQL.format(recent=""), ["v_classified"]))
def timeline_6h_all(spark, sf):
    return _six_hours(spark, sf, None)


_STANCE_DAYS_SQL = """
SELECT time_bucket(INTERVAL 1 DAY, epoch_ms(created_utc * 1000)) AS bucket_start, stance,
       count(*) AS n_comments, count(toxicity) AS n_scored,
       floor(CAST(sum(CAST(round(toxicity * 1e9) AS BIGINT)) AS DOUBLE) / nullif(count(toxicity), 0) / 1e9 * 1e6 + 0.5) / 1e6
         AS avg_toxicity
FROM v_classified GROUP BY ALL"""


@query("toxicity_by_stance_window", "E2 T5", with_views(_STANCE_DAYS_SQL, ["v_classified"]))
def toxicity_by_stance_window(spark, sf):
    d = rollup.toxicity_by_stance_window(T.v_classified(spark, sf), "1 day")
    return d.withColumn("avg_toxicity", half_up(F.col("avg_toxicity"), 6))


@query("daily_stats_upsert", "S9 J14 P16", with_views(f"""
WITH d AS ({_DAILY_SQL}),
old AS (SELECT topic_id, date, 0 AS stance_support_count, 0 AS stance_oppose_count,
          0 AS stance_mixed_count, 0 AS stance_neutral_count, 0 AS total_comments,
          CAST(NULL AS DOUBLE) AS avg_toxicity FROM d),
fresh AS (SELECT * FROM d WHERE topic_id < 10)
SELECT topic_id, date, CAST(stance_support_count AS BIGINT) AS stance_support_count,
  CAST(stance_oppose_count AS BIGINT) AS stance_oppose_count,
  CAST(stance_mixed_count AS BIGINT) AS stance_mixed_count,
  CAST(stance_neutral_count AS BIGINT) AS stance_neutral_count,
  CAST(total_comments AS BIGINT) AS total_comments, avg_toxicity
FROM old WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.topic_id = old.topic_id AND f.date = old.date)
UNION ALL SELECT * FROM fresh""", ["v_classified"]))
def daily_stats_upsert(spark, sf):
    """A rerun that recomputes only the active topics (ids < 10 here) must
    replace their rows and keep every other topic's existing rows."""
    d = _daily(spark, sf)
    old = d.select("topic_id", "date",
                   *[F.lit(0).cast("bigint").alias(c) for c in
                     list(rollup.STANCE_COLS.values()) + ["total_comments"]],
                   F.lit(None).cast("double").alias("avg_toxicity"))
    topics = d.select("topic_id").distinct().select(
        "topic_id", F.when(F.col("topic_id") < 10, "active").otherwise("archived").alias("status"))
    fresh = rollup.active_topics_only(d, topics)
    return rollup.upsert_daily_stats(old, fresh)


@query("stance_breakdown", "A2 J5 Q2", with_views("""
WITH c AS (SELECT topic_id, stance, count(*) AS n FROM v_classified GROUP BY ALL),
z AS (SELECT DISTINCT topic_id, s.stance FROM c,
        (SELECT unnest(['SUPPORT', 'OPPOSE', 'MIXED', 'NEUTRAL']) AS stance) s)
SELECT coalesce(z.topic_id, c.topic_id) AS topic_id, coalesce(z.stance, c.stance) AS stance,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM z FULL OUTER JOIN c ON z.topic_id = c.topic_id AND z.stance = c.stance""", ["v_classified"]))
def stance_breakdown(spark, sf):
    v = T.v_classified(spark, sf)
    return reports.stance_breakdown(v.select("comment_id", "topic_id"),
                                    v.select("comment_id", "stance"))


@query("stance_distribution", "A14", with_views("""
SELECT stance, count(*) AS n FROM v_classified GROUP BY stance ORDER BY n DESC, stance""",
                                               ["v_classified"]))
def stance_distribution(spark, sf):
    return reports.stance_distribution(T.v_classified(spark, sf))


@query("topic_overview", "J11 A3 A4 A12 E5", with_views("""
WITH pc AS (SELECT topic_id, count(*) AS post_count, arg_min(title, post_id) AS name FROM v_post GROUP BY topic_id),
cc AS (SELECT topic_id, count(*) AS comment_count, max(created_utc) AS last_updated_utc
       FROM v_comment GROUP BY topic_id),
kc AS (SELECT topic_id, count(*) AS classified_count FROM v_comment
       WHERE comment_id IN (SELECT comment_id FROM v_comment_class) GROUP BY topic_id)
SELECT coalesce(pc.topic_id, cc.topic_id) AS topic_id, pc.name,
  CAST(coalesce(post_count, 0) AS BIGINT) AS post_count,
  CAST(coalesce(comment_count, 0) AS BIGINT) AS comment_count,
  CAST(coalesce(classified_count, 0) AS BIGINT) AS classified_count, last_updated_utc
FROM pc FULL OUTER JOIN cc ON pc.topic_id = cc.topic_id
LEFT JOIN kc ON kc.topic_id = coalesce(pc.topic_id, cc.topic_id)
ORDER BY comment_count DESC, topic_id""", ["v_post", "v_comment", "v_comment_class"]))
def topic_overview(spark, sf):
    return reports.topic_overview(T.v_comment(spark, sf), T.v_post(spark, sf),
                                  T.v_comment_class(spark, sf))


_PAGE_COLS = "comment_id, body, author_hash, created_utc, score, stance, sentiment, toxicity_score"


@query("comments_newest_page", "K1 K4 P18 Q6", with_views(f"""
WITH d AS (
  SELECT c.*, coalesce(k.stance, 'NEUTRAL') AS stance, coalesce(k.sentiment, 'NEUTRAL') AS sentiment,
         coalesce(k.toxicity, 0.0) AS toxicity_score
  FROM v_comment c LEFT JOIN v_comment_class k USING (comment_id) WHERE c.topic_id = 3)
SELECT {_PAGE_COLS}, (SELECT count(*) FROM d) AS total
FROM d ORDER BY created_utc DESC, comment_id LIMIT 20 OFFSET 5""",
                                                     ["v_comment", "v_comment_class"]))
def comments_newest_page(spark, sf):
    return reports.comments_page(T.v_comment(spark, sf), T.v_comment_class(spark, sf), 3,
                                 sort_by="newest", limit=20, offset=5)


@query("comments_top_scored", "K2 K3 K4", with_views(f"""
WITH d AS (
  SELECT c.*, coalesce(k.stance, 'NEUTRAL') AS stance, coalesce(k.sentiment, 'NEUTRAL') AS sentiment,
         coalesce(k.toxicity, 0.0) AS toxicity_score
  FROM v_comment c LEFT JOIN v_comment_class k USING (comment_id) WHERE c.topic_id = 7)
SELECT {_PAGE_COLS}, (SELECT count(*) FROM d) AS total
FROM d ORDER BY score DESC, comment_id LIMIT 25""", ["v_comment", "v_comment_class"]))
def comments_top_scored(spark, sf):
    return reports.comments_page(T.v_comment(spark, sf), T.v_comment_class(spark, sf), 7,
                                 sort_by="scored", limit=25)


@query("comments_filtered", "P13 Q5 Q6", with_views(f"""
WITH d AS (
  SELECT c.*, k.stance, k.sentiment, k.toxicity AS toxicity_score
  FROM v_comment c JOIN v_comment_class k USING (comment_id)
  WHERE c.topic_id = 5 AND k.stance = 'OPPOSE' AND k.toxicity >= 0.02 AND k.toxicity <= 0.85)
SELECT {_PAGE_COLS}, (SELECT count(*) FROM d) AS total
FROM d ORDER BY created_utc DESC, comment_id LIMIT 50""", ["v_comment", "v_comment_class"]))
def comments_filtered(spark, sf):
    return reports.comments_page(T.v_comment(spark, sf), T.v_comment_class(spark, sf), 5,
                                 stance="OPPOSE", toxicity_min=0.02, toxicity_max=0.85)


@query("classification_coverage", "J12 A13 A15", with_views("""
SELECT CAST(count(*) AS BIGINT) AS total_comments, CAST(count(k.comment_id) AS BIGINT) AS classified,
  CAST(count(*) - count(k.comment_id) AS BIGINT) AS pending,
  round(coalesce(100.0 * count(k.comment_id) / nullif(count(*), 0), 0), 1) AS coverage_pct
FROM v_comment c LEFT JOIN v_comment_class k USING (comment_id)""", ["v_comment", "v_comment_class"]))
def classification_coverage(spark, sf):
    return reports.classification_coverage(T.v_comment(spark, sf), T.v_comment_class(spark, sf))


@query("unclassified_backlog", "J1 K9", with_views("""
SELECT comment_id, topic_id, created_utc FROM v_comment c
WHERE body IS NOT NULL AND body <> ''
  AND NOT EXISTS (SELECT 1 FROM v_comment_class k WHERE k.comment_id = c.comment_id)""",
                                                     ["v_comment", "v_comment_class"]))
def unclassified_backlog(spark, sf):
    return reports.unclassified_backlog(T.v_comment(spark, sf), T.v_comment_class(spark, sf))


@query("classified_gate", "J6 A5 E8", with_views("""
WITH n AS (SELECT topic_id, count(*) AS k FROM v_comment
           WHERE comment_id IN (SELECT comment_id FROM v_comment_class) GROUP BY topic_id)
SELECT t.topic_id, CAST(coalesce(n.k, 0) AS BIGINT) AS classified_comments,
  coalesce(n.k, 0) >= 25 AS clustering_available,
  CASE WHEN coalesce(n.k, 0) >= 25 THEN NULL ELSE 'insufficient_data' END AS reason,
  CAST(25 AS BIGINT) AS required
FROM (SELECT DISTINCT topic_id FROM v_comment) t LEFT JOIN n USING (topic_id)""",
                                               ["v_comment", "v_comment_class"]))
def classified_gate(spark, sf):
    return reports.classified_gate(T.v_comment(spark, sf), T.v_comment_class(spark, sf),
                                   minimum=25)


@query("recent_posts", "K7", with_views("""
SELECT post_id, topic_id, external_id, title, created_utc, target_terms FROM v_post
ORDER BY created_utc DESC, post_id DESC LIMIT 10""", ["v_post"]))
def recent_posts(spark, sf):
    return reports.recent_posts(T.v_post(spark, sf)).select(
        "post_id", "topic_id", "external_id", "title", "created_utc", "target_terms")


@query("stance_shares", "F: ISO format, day label, percent format", with_views("""
WITH d AS (SELECT CAST(epoch_ms(created_utc * 1000) AS DATE) AS day, max(created_utc) AS newest, count(*) AS n,
           count(*) FILTER (WHERE stance = 'SUPPORT') AS support FROM v_classified GROUP BY 1)
SELECT strftime(epoch_ms(newest * 1000), '%Y-%m-%dT%H:%M:%SZ') AS newest_iso, strftime(day, '%b %-d') AS day_label,
  printf('%.1f', round(support / n * 100, 1)) || '%' AS support_pct, n
FROM d""", ["v_classified"]))
def stance_shares(spark, sf):
    c = T.v_classified(spark, sf)
    day = F.to_date(F.timestamp_seconds("created_utc"))
    d = c.groupBy(day.alias("day")).agg(F.max("created_utc").alias("newest"), F.count(F.lit(1)).alias("n"),
                                        F.count_if(F.col("stance") == "SUPPORT").alias("support"))
    return d.select(iso_utc(F.col("newest")).alias("newest_iso"), day_label(F.col("day")).alias("day_label"),
                    percent(F.col("support") / F.col("n")).alias("support_pct"), "n")


@query("comments_deep_page", "K4, a page at three fifths of all comments, found without sorting them", with_views("""
WITH r AS (SELECT comment_id, topic_id, score, created_utc,
                  row_number() OVER (ORDER BY score DESC, comment_id) - 1 AS pos, count(*) OVER () * 3 // 5 AS start
           FROM v_comment)
SELECT comment_id, topic_id, score, created_utc FROM r WHERE pos >= start AND pos < start + 50""", ["v_comment"]))
def comments_deep_page(spark, sf):
    c = T.v_comment(spark, sf).select("comment_id", "topic_id", "score", "created_utc")
    return paging.page(c, [("score", True), ("comment_id", False)], c.count() * 3 // 5, 50, small=1000)
