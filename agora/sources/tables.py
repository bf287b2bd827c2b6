"""Driver tables and the domain views built on them.

The driver's tables hold no forum data, so each query starts from a
deterministic view that maps a driver table onto the domain model (comments,
classifications, posts, threads, vectors). Each view is defined twice, side
by side: as a Spark DataFrame (what queries run on) and as DuckDB SQL (what
the oracle runs on). Both read the whole table; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.text import target_entities
from agora.session import configure

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

# Base epoch of v_comment (2024-01-01 00:00:00 UTC) and spacing of comments.
COMMENT_EPOCH = 1704067200
COMMENT_SPACING = 600
N_EVENT_TOPICS = 20
# Item ids of a conversation lie in a range of its own, wider than any conversation is long.
THREAD_STRIDE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


EVENT_STANCE = {"purchase": "SUPPORT", "error": "OPPOSE", "click": "MIXED",
                "view": "NEUTRAL", "signup": "OTHER"}


def v_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified comments from ``events`` (one per event).

    stance from event_type (signup -> an unknown label), toxicity NULL for
    every 7th event, otherwise value/500 capped at 1.
    """
    return classified_from_events(table(spark, sf_dir, "events"))


def classified_from_events(ev: DataFrame) -> DataFrame:
    """v_classified over any events DataFrame (batch or stream)."""
    return ev.select(
        F.col("event_id").alias("comment_id"),
        (F.col("user_id") % N_EVENT_TOPICS).alias("topic_id"),
        F.col("user_id").alias("post_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_utc"),
        _case(F.col("event_type"), EVENT_STANCE).alias("stance"),
        F.element_at(F.array(*[F.lit(s) for s in lexicon.SENTIMENTS]),
                     (F.col("event_id") % 3 + 1).cast("int")).alias("sentiment"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.least(F.col("value") / 500.0, F.lit(1.0))).alias("toxicity"),
        F.get_json_object("props", "$.k").cast("int").alias("score"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("author_hash"),
    )


def v_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments from ``documents``: topic = source, one post per topic."""
    return comments_from_documents(table(spark, sf_dir, "documents"))


def comments_from_documents(d: DataFrame) -> DataFrame:
    """v_comment over any documents DataFrame (batch or stream)."""
    topic = F.substring("source", 4, 64).cast("bigint")
    return d.select(
        F.col("doc_id").alias("comment_id"),
        topic.alias("topic_id"),
        topic.alias("post_id"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("text").alias("body"),
        (F.col("n_chars") % 100).cast("int").alias("score"),
        (F.lit(COMMENT_EPOCH) + F.col("doc_id") * COMMENT_SPACING).alias("created_utc"),
        F.sha2(F.concat(F.lit("user"), (F.col("doc_id") % 37).cast("string")), 256)
         .alias("author_hash"),
        F.col("lang"),
    )


def v_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual labels (partial cover of the comments)."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("comment_id"), "quality", "toxic")


def v_comment_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications of the labelled comments only (the rest are pending)."""
    lab = v_label(spark, sf_dir)
    return lab.select(
        "comment_id",
        F.element_at(F.array(*[F.lit(s) for s in lexicon.STANCES]),
                     (F.col("comment_id") % 4 + 1).cast("int")).alias("stance"),
        F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "POSITIVE")
         .otherwise("NEUTRAL").alias("sentiment"),
        (F.col("toxic").cast("double") * 0.8 + (F.col("comment_id") % 10) / 100.0)
        .alias("toxicity"),
    )


def v_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per topic of v_comment: title = first line of its first comment.

    target_terms are the title's entities (P3), comma-joined as stored.
    """
    c = v_comment(spark, sf_dir)
    first = (c.groupBy("topic_id")
             .agg(F.min_by("body", "comment_id").alias("body"),
                  F.min("created_utc").alias("created_utc"),
                  F.min("comment_id").alias("first_comment_id")))
    title = F.substring(F.split(F.col("body"), "\n").getItem(0), 1, lexicon.TITLE_MAX)
    return first.select(
        F.col("topic_id").alias("post_id"), "topic_id",
        F.concat(F.lit("src"), F.col("topic_id").cast("string")).alias("external_id"),
        title.alias("title"), "created_utc",
    ).withColumn("target_terms", F.array_join(target_entities(F.col("title")), ","))


def v_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply items from ``conversations``: a story per conversation.

    Item ids: story = conv_id * THREAD_STRIDE, turn t = story + t + 1. Turns 0
    and 1 reply to the story, turn t >= 2 replies to turn t//2 - 1, which
    makes a small tree (depth 0..2).
    """
    cv = table(spark, sf_dir, "conversations")
    story = F.col("conv_id") * THREAD_STRIDE
    parent = F.when(F.col("turn") < 2, story) \
        .otherwise(story + (F.floor(F.col("turn") / 2) - 1) + 1)
    return cv.select(
        (story + F.col("turn") + 1).alias("id"),
        F.col("conv_id").alias("story_id"),
        F.col("turn"),
        parent.cast("bigint").alias("parent"),
        F.col("role").alias("by"),
        F.col("text"),
        (F.lit(COMMENT_EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("time"),
        (F.length("text") % 50).cast("int").alias("score"),
    )


def v_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment vectors from ``embeddings``; stance bucket = label % 4."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("comment_id"),
        F.element_at(F.array(*[F.lit(s) for s in lexicon.STANCES]),
                     (F.col("label") % 4 + 1).cast("int")).alias("stance"),
        (F.col("label") % 3).cast("bigint").alias("topic_id"),
        F.col("embedding"),
    )


def v_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles (HTML <title>, entities unescaped for &amp; only)."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return p.select(F.col("page_id"), F.col("url"),
                    F.replace(title, F.lit("&amp;"), F.lit("&")).alias("title"))


# ---------------------------------------------------------------------------
# The same views in DuckDB SQL (oracle side). Kept next to the Spark ones.
# ---------------------------------------------------------------------------

def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} END"


def sql_target_entities(title: str, key: str, src: str, max_entities: int | None = None) -> str:
    """DuckDB query giving (key, terms) = P3 of ``title`` for each row of src.

    Written as unnest + group-by, a different formulation from the Spark
    array expression.
    """
    known = _sql_list([k.lower() for k in lexicon.KNOWN_ENTITIES])
    stop = _sql_list(lexicon.ENTITY_STOP_WORDS)
    limit = "" if max_entities is None else f" LIMIT {max_entities}"
    return f"""
    SELECT s.{key} AS k,
      coalesce((SELECT list(tok ORDER BY pos) FROM (
          SELECT arg_min(tok, pos) AS tok, min(pos) AS pos FROM (
            SELECT unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos
            FROM (SELECT regexp_extract_all(coalesce(s.{title}, ''), '[A-Za-z][\\w.+#-]*') AS toks))
          WHERE list_contains({known}, lower(tok))
             OR (pos > 1 AND regexp_matches(tok, '^[A-Z]') AND length(tok) > 2
                 AND NOT list_contains({stop}, lower(tok)))
          GROUP BY lower(tok) ORDER BY pos{limit})), []) AS terms
    FROM {src} s"""


def oracle_views() -> dict[str, str]:
    """DuckDB definitions of the views, usable as CTEs."""
    stances = _sql_list(lexicon.STANCES)
    sentiments = _sql_list(lexicon.SENTIMENTS)
    return {
        "v_classified": f"""
SELECT event_id AS comment_id, user_id % {N_EVENT_TOPICS} AS topic_id, user_id AS post_id,
  CAST(epoch_us(ts) // 1000000 AS BIGINT) AS created_utc,
  {_sql_case('event_type', EVENT_STANCE)} AS stance,
  {sentiments}[event_id % 3 + 1] AS sentiment,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE least(value / 500.0, CAST(1.0 AS DOUBLE)) END AS toxicity,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS score,
  sha256(CAST(user_id AS VARCHAR)) AS author_hash
FROM events""",
        "v_comment": f"""
SELECT doc_id AS comment_id, CAST(substr(source, 4) AS BIGINT) AS topic_id,
  CAST(substr(source, 4) AS BIGINT) AS post_id, CAST(doc_id AS VARCHAR) AS external_id,
  text AS body, CAST(n_chars % 100 AS INTEGER) AS score,
  {COMMENT_EPOCH} + doc_id * {COMMENT_SPACING} AS created_utc,
  sha256('user' || CAST(doc_id % 37 AS VARCHAR)) AS author_hash, lang
FROM documents""",
        "v_label": "SELECT doc_id AS comment_id, quality, toxic FROM labels",
        "v_comment_class": f"""
SELECT doc_id AS comment_id, {stances}[doc_id % 4 + 1] AS stance,
  CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment,
  CAST(toxic AS DOUBLE) * 0.8 + (doc_id % 10) / 100.0 AS toxicity
FROM labels""",
        "v_post_title": f"""
SELECT topic_id AS post_id, topic_id, 'src' || CAST(topic_id AS VARCHAR) AS external_id,
  substr(split_part(arg_min(body, comment_id), chr(10), 1), 1, {lexicon.TITLE_MAX}) AS title,
  min(created_utc) AS created_utc
FROM v_comment GROUP BY topic_id""",
        "v_post": f"""
SELECT p.*, array_to_string(e.terms, ',') AS target_terms
FROM v_post_title p JOIN ({sql_target_entities('title', 'post_id', 'v_post_title')}) e
  ON e.k = p.post_id""",
        "v_thread": f"""
SELECT conv_id * {THREAD_STRIDE} + turn + 1 AS id, conv_id AS story_id, turn,
  CAST(CASE WHEN turn < 2 THEN conv_id * {THREAD_STRIDE} ELSE conv_id * {THREAD_STRIDE} + (turn // 2 - 1) + 1 END AS BIGINT) AS parent,
  role AS "by", text, {COMMENT_EPOCH} + conv_id * 3600 + turn * 60 AS time,
  CAST(length(text) % 50 AS INTEGER) AS score
FROM conversations""",
        "v_vector": f"""
SELECT vec_id AS comment_id, {stances}[label % 4 + 1] AS stance,
  CAST(label % 3 AS BIGINT) AS topic_id, embedding
FROM embeddings""",
        "v_page": """
SELECT page_id, url,
  replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') AS title
FROM pages""",
    }


_VIEW_ORDER = ["v_classified", "v_comment", "v_label", "v_comment_class",
               "v_post_title", "v_post", "v_thread", "v_vector", "v_page"]


def with_views(sql: str, views: list[str]) -> str:
    """Prefix ``sql`` with the CTEs it needs (dependencies included)."""
    deps = {"v_post": ["v_comment", "v_post_title"], "v_post_title": ["v_comment"]}
    need: list[str] = []

    def add(v):
        for d in deps.get(v, []):
            add(d)
        if v not in need:
            need.append(v)

    for v in views:
        add(v)
    defs = oracle_views()
    ordered = [v for v in _VIEW_ORDER if v in need]
    ctes = ",\n".join(f"{v} AS ({defs[v]})" for v in ordered)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
