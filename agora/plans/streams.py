"""Catalogue: streaming queries (run to completion with availableNow and
read back; each must equal its batch twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions.scalar import half_up
from agora.functions.text import is_blank, target_entities
from agora.operators.rollup import mean_of
from agora.plans.analytics import _DAILY_SQL, _SIX_HOURS_SQL, _STANCE_DAYS_SQL
from agora.plans.ingestion import _COMMENTS_SQL, _comments, _thread_items
from agora.plans.registry import query
from agora.plans.textops import _split_sql, _sql_term_hit
from agora.sources import tables as T
from agora.sources import versioned as V
from agora.sources.tables import with_views
from agora.streaming import caps as C
from agora.streaming import streams as S


@query("stream_daily_stats", "T1 T3 T6 A1", with_views(_DAILY_SQL, ["v_classified"]))
def stream_daily_stats(spark, sf):
    ev = S.stream_table(spark, sf, "events")
    partials = S.run_update(S.daily_partials(T.classified_from_events(ev)), "daily",
                            ["topic_id", "date", "stance"])
    d = S.finish_daily(partials)
    return d.withColumn("avg_toxicity", half_up(F.col("avg_toxicity"), 6))


@query("stream_timeline_6h", "T4 E1", with_views(_SIX_HOURS_SQL.format(recent=""), ["v_classified"]))
def stream_timeline_6h(spark, sf):
    ev = S.stream_table(spark, sf, "events")
    partials = S.run_update(S.windowed_partials(T.classified_from_events(ev)), "six-hours",
                            ["topic_id", "bucket_start", "stance"])
    d = S.finish_rollup(partials, ["topic_id", "bucket_start"])
    return d.withColumn("avg_toxicity", half_up(F.col("avg_toxicity"), 6))


@query("stream_toxicity_by_stance", "T5 E2", with_views(_STANCE_DAYS_SQL, ["v_classified"]))
def stream_toxicity_by_stance(spark, sf):
    ev = S.stream_table(spark, sf, "events")
    p = S.run_update(S.stance_window_partials(T.classified_from_events(ev)), "stance-days",
                     ["bucket_start", "stance"])
    return p.select("bucket_start", "stance", "n_comments", "n_scored",
                    half_up(mean_of(F.col("tox_units"), F.col("n_scored")), 6).alias("avg_toxicity"))


@query("stream_dedup", "T2 U4", with_views("""
SELECT DISTINCT event_id, user_id, event_type, value FROM events""", []))
def stream_dedup(spark, sf):
    """The same event file arrives twice (two sources); each event is kept once."""
    a = S.stream_table(spark, sf, "events")
    b = S.stream_table(spark, sf, "events")
    both = a.unionByName(b).withColumn("event_time", F.col("ts").cast("timestamp"))
    d = S.dedup_stream(both, ["event_id"], "event_time")
    out = S.run_append(d.select("event_id", "event_time", "user_id", "event_type", "value"),
                       "dedup")
    return out.select("event_id", "user_id", "event_type", "value")


@query("stream_gate", "T7 P5 J7", with_views(f"""
WITH j AS (SELECT c.comment_id, c.post_id, c.body, {_split_sql('p.target_terms')} AS terms
           FROM v_comment c LEFT JOIN v_post p ON p.post_id = c.post_id)
SELECT comment_id, post_id, CAST(len(terms) AS INTEGER) AS n_terms,
  len(terms) = 0 OR list_bool_or(list_transform(terms, lambda t:
      {_sql_term_hit("lower(coalesce(body, ''))", 'lower(t)')})) AS on_target
FROM j""", ["v_comment", "v_post"]))
def stream_gate(spark, sf):
    docs = S.stream_table(spark, sf, "documents")
    gated = S.gate_stream(T.comments_from_documents(docs), T.v_post(spark, sf))
    return S.run_append(gated, "gate")


@query("stream_caps", "T8 W1", with_views("""
SELECT conv_id, turn, role, CAST(running AS BIGINT) AS running FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS running
  FROM conversations) WHERE running <= 5""", []))
def stream_caps(spark, sf):
    """Turns of each conversation arrive as a stream; at most 5 per
    conversation are kept, counted across micro-batches."""
    conv = S.stream_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    out = S.run_capped(conv, "caps", "conv_id", ["turn"], cap=5)
    return out.select("conv_id", "turn", "role", F.col("running").cast("bigint"))


def _arriving(spark, work, parts, run):
    """Each of ``parts`` arrives in the input folder and is taken in by ``run(stream)`` before the next; all of
    them are read. Returns the last run's result."""
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{work}/in")
        out = run(spark.readStream.schema(part.schema).parquet(f"{work}/in"))
    return out


def _thirds(rows, time="created_utc"):
    """``rows`` with ``arrival`` 0, 1, 2 by thirds of the time they span."""
    low, high = rows.agg(F.min(time), F.max(time)).first()  # two numbers
    if low is None:
        return rows.withColumn("arrival", F.lit(0)), 0
    return rows.withColumn("arrival", F.floor((F.col(time) - low) * 3 / F.lit(high - low + 1)).cast("int")), high


CAPS = {"per_post": 4, "per_topic": 25, "per_cycle": 8, "cycle": 86400}


@query("stream_cycle_caps", "T8 W1 A11, caps per post, topic and daily cycle", with_views("""
WITH RECURSIVE c AS (
  SELECT topic_id, post_id, created_utc // 86400 AS k,
         list({'at': created_utc, 'id': comment_id} ORDER BY created_utc, comment_id) AS items
  FROM v_classified GROUP BY ALL),
r(topic_id, post_id, k, post_n, topic_n, got) AS (
  SELECT DISTINCT topic_id, post_id, (SELECT min(k) - 1 FROM c), CAST(0 AS BIGINT), CAST(0 AS HUGEINT),
         CAST([] AS STRUCT("at" BIGINT, id BIGINT)[]) FROM v_classified
  UNION ALL
  SELECT topic_id, post_id, k, post_n + len(got), topic_n + sum(len(got)) OVER (PARTITION BY topic_id), got FROM (
    SELECT topic_id, post_id, k, post_n, topic_n,
           coalesce(list(item ORDER BY item) FILTER (item IS NOT NULL AND rn <= least(8, 25 - topic_n)), []) AS got
    FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY item) AS rn
          FROM (SELECT r.topic_id, r.post_id, r.k + 1 AS k, r.post_n, r.topic_n,
                       unnest(list_concat(list_slice(coalesce(c.items, []), 1, 4 - r.post_n), [NULL])) AS item
                FROM r LEFT JOIN c ON c.topic_id = r.topic_id AND c.post_id = r.post_id AND c.k = r.k + 1
                WHERE r.k < (SELECT max(k) FROM c)))
    GROUP BY topic_id, post_id, k, post_n, topic_n)),
g AS (SELECT topic_id, post_id, k, unnest(got) AS x FROM r)
SELECT topic_id, post_id, x.id AS comment_id, x."at" AS created_utc, k * 86400 AS cycle_start,
  row_number() OVER (PARTITION BY topic_id, post_id ORDER BY x."at", x.id) AS post_no,
  row_number() OVER (PARTITION BY topic_id ORDER BY k, x."at", x.id) AS topic_no,
  row_number() OVER (PARTITION BY topic_id, k ORDER BY x."at", x.id) AS cycle_no
FROM g""", ["v_classified"]))
def stream_cycle_caps(spark, sf):
    """Comments arrive in three parts; within two days they may come in any order."""
    work = S._workdir(spark, "cycle-caps")
    columns = ["topic_id", "post_id", "comment_id", "created_utc"]
    rows, newest = _thirds(T.v_classified(spark, sf).select(*columns))
    parts = [rows.where(F.col("arrival") == a).select(*columns) for a in range(3)]
    parts.append(C.closing_row(spark, newest + 4 * 86400))
    return _arriving(spark, work, parts, lambda stream: C.run_cycle_caps(
        stream, "cycle-caps", f"{work}/run", delay="2 days", **CAPS))


_ARRIVALS_SQL = """
b AS (SELECT min(created_utc) AS low, max(created_utc) AS high FROM v_classified),
a AS (SELECT v.*, CASE WHEN comment_id % 10 = 0 THEN 3
             ELSE CAST(floor((created_utc - low) * 3 / (high - low + 1)) AS INTEGER) END AS arrival
      FROM v_classified v, b),
late AS (SELECT a.* FROM a WHERE (created_utc // 86400 + 1) * 86400 <=
           (SELECT max(e.created_utc) - 86400 FROM a e WHERE e.arrival < a.arrival))"""


def _late(spark, sf):
    """Daily rollup of comments that arrive by thirds of time, but for every tenth, which comes after all others."""
    work = S._workdir(spark, "late")
    rows = T.v_classified(spark, sf).select("topic_id", "comment_id", "created_utc", "stance", "toxicity")
    timed, _ = _thirds(rows)
    arrival = F.when(F.col("comment_id") % 10 == 0, 3).otherwise(F.col("arrival"))
    parts = [timed.where(arrival == a).drop("arrival") for a in range(4)]
    return rows, _arriving(spark, work, parts, lambda stream: S.run_daily_with_late_rows(
        stream, "late", 86400, f"{work}/run"))


@query("stream_late_rows", "T6, side table of what the watermark drops", with_views(f"""
WITH {_ARRIVALS_SQL}
SELECT topic_id, comment_id, created_utc, stance, toxicity FROM late""", ["v_classified"]))
def stream_late_rows(spark, sf):
    return _late(spark, sf)[1][1]


@query("stream_late_repair", "T6 T3 A1, streamed rollup with late days counted again", with_views(_DAILY_SQL, ["v_classified"]))
def stream_late_repair(spark, sf):
    rows, (partials, late) = _late(spark, sf)
    d = S.finish_daily(S.repair_days(partials, late, rows))
    return d.withColumn("avg_toxicity", half_up(F.col("avg_toxicity"), 6))


@query("stream_upsert_comments", "T2 S8 J14 Q15, stored table", with_views(r"""
SELECT external_id, CASE WHEN lang IN ('en', 'de') THEN body ELSE upper(body) END AS body,
  CASE WHEN lang = 'de' THEN score ELSE score + 7 END AS score,
  CAST(CASE WHEN lang = 'de' THEN 1 ELSE 2 END AS BIGINT) AS ingested_at
FROM v_comment WHERE lang IN ('en', 'de', 'fr', 'es')
  AND body IS NOT NULL AND NOT regexp_matches(body, '^[\s\p{Z}]*$')""", ["v_comment"]))
def stream_upsert_comments(spark, sf):
    """Three arrivals: comments in two languages, later versions of one of them with new ones, and old versions
    of the other, which refresh nothing."""
    work = S._workdir(spark, "upsert-comments")
    c = T.v_comment(spark, sf).where(~is_blank(F.col("body")))
    at = lambda version: F.lit(version).cast("long").alias("ingested_at")
    parts = [
        c.where(F.col("lang").isin("en", "de")).select("external_id", "body", "score", at(1)),
        c.where(F.col("lang").isin("en", "fr", "es")).select(
            "external_id", F.upper("body").alias("body"), (F.col("score") + 7).alias("score"), at(2)),
        c.where(F.col("lang") == "de").select("external_id", "body", (F.col("score") + 100).alias("score"), at(0))]
    tables = V.Tables(spark, f"{work}/store", {"comments": parts[0].schema}, {"comments": ["external_id"]}, buckets=16)
    _arriving(spark, work, parts, lambda stream: V.upsert_stream(
        stream, tables, "comments", ["score"], "ingested_at", f"{work}/checkpoint"))
    return tables.read("comments")


@query("stream_upsert_stories", "T2 S7 J14 Q15 P3, stored table", with_views(f"""
SELECT CAST(page_id AS VARCHAR) AS external_id, title,
  CAST(CASE WHEN length(title) % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS score,
  CASE WHEN length(title) % 2 = 0 THEN 1700001800 ELSE 1700000000 END AS last_processed_utc,
  array_to_string(e.terms, ',') || CASE WHEN length(title) % 2 = 0 THEN ',again' ELSE '' END AS target_terms
FROM v_page JOIN ({T.sql_target_entities('title', 'page_id', 'v_page')}) e ON e.k = page_id""", ["v_page"]))
def stream_upsert_stories(spark, sf):
    """Stories come twice: score, processing time and target terms are refreshed, the title is not."""
    work = S._workdir(spark, "upsert-stories")
    terms = F.array_join(target_entities(F.col("title")), ",")
    v = T.v_page(spark, sf)
    once = v.select(F.col("page_id").cast("string").alias("external_id"), "title", F.lit(1).alias("score"),
                    F.lit(1700000000).alias("last_processed_utc"), terms.alias("target_terms"))
    again = (once.where(F.length("title") % 2 == 0)
             .select("external_id", F.upper("title").alias("title"), F.lit(2).alias("score"),
                     F.lit(1700001800).alias("last_processed_utc"),
                     F.concat("target_terms", F.lit(",again")).alias("target_terms")))
    tables = V.Tables(spark, f"{work}/store", {"stories": once.schema}, {"stories": ["external_id"]}, buckets=16)
    _arriving(spark, work, [once, again], lambda stream: V.upsert_stream(
        stream, tables, "stories", ["score", "target_terms"], "last_processed_utc", f"{work}/checkpoint"))
    return tables.read("stories")


def _item_files(spark, sf):
    """Thread items arrive as JSON lines in three parts; the first also holds a cut-off copy of every 17th item's
    line, and old versions (score -1) of items that
    the last sends again."""
    work = S._workdir(spark, "items")
    items, roots = _thread_items(spark, sf)
    line = F.to_json(F.struct(*items.columns))
    old = F.to_json(F.struct(*[F.lit(-1).alias(c) if c == "score" else F.col(c) for c in items.columns]))
    whole = [items.where(F.pmod("id", F.lit(3)) == a).select(line.alias("value")) for a in range(3)]
    again = items.where((F.pmod("id", F.lit(3)) != 2) & (F.col("id") % 5 == 0))
    cut = items.where(F.col("id") % 17 == 0).select(line.alias("line")).select(
        F.expr("substring(line, 1, length(line) - 1)").alias("value"))
    parts = [whole[0].unionByName(cut).unionByName(again.select(old.alias("value"))), whole[1],
             whole[2].unionByName(again.select(line.alias("value")))]
    for part in parts:
        part.write.mode("append").text(f"{work}/in")
        out = S.run_items(S.item_stream(spark, f"{work}/in", f"{work}/archive"), "items", f"{work}/run")
    return out, roots


@query("stream_items", "T1 S1 P6 P8 P9 P11, JSON lines", with_views(_COMMENTS_SQL, ["v_thread"]))
def stream_items(spark, sf):
    (items, _), roots = _item_files(spark, sf)
    return _comments(S.latest_items(items), roots)


@query("stream_broken_lines", "T1 S1, side table of unreadable lines", with_views("""
SELECT id, 'unreadable' AS reason FROM v_thread WHERE id % 17 = 0""", ["v_thread"]))
def stream_broken_lines(spark, sf):
    (_, broken), _ = _item_files(spark, sf)
    return broken.select(F.regexp_extract("line", r'"id":(\d+)', 1).cast("long").alias("id"), "reason")
