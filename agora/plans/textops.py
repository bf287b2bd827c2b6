"""Catalogue: text predicates and extractors (P1-P9, P19, P21, E4, M2/M3 contracts)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from agora import lexicon
from agora.functions import text as X
from agora.functions.scalar import hypothesis_labels
from agora.operators import ingest
from agora.operators.common import with_target_terms
from agora.plans.registry import query
from agora.sources import tables as T
from agora.sources.tables import _sql_list, sql_target_entities, with_views

# Extra scope terms that occur in the driver's invented titles (parameters).
EXTRA_SCOPE_TERMS = ["that", "der", "la", "is the"]

_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"


def _sql_term_hit(text_sql: str, term_sql: str) -> str:
    """DuckDB: one term against lower-cased text, per-term formulation
    (regexp_escape + explicit boundary), used as an independent oracle."""
    return (f"CASE WHEN contains({term_sql}, ' ') THEN contains({text_sql}, {term_sql}) "
            f"ELSE regexp_matches({text_sql}, "
            f"(CASE WHEN regexp_matches({term_sql}, '^{_W}') THEN '(^|{_NW})' ELSE '{_W}' END) || "
            f"regexp_escape({term_sql}) || "
            f"(CASE WHEN regexp_matches({term_sql}, '{_W}$') THEN '({_NW}|$)' ELSE '{_W}' END)) END")


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _scope_sql(extra: list[str]) -> str:
    """P1 over a materialised lower-cased title ``t`` and its words ``toks``: plain words by list
    membership, phrases by containment, and the few terms with other characters by a literal pattern each."""
    kws = [k.lower() for k in lexicon.DEFAULT_TOPIC_KEYWORDS + extra]
    words = [k for k in kws if re.fullmatch(r"\w+", k)]
    tests = ["starts_with(t, 'ask hn:')", "starts_with(t, 'show hn:')", f"list_has_any(toks, {_sql_list(words)})"]
    for k in kws:
        if " " in k:
            tests.append(f"contains(t, {_sql_list([k])[1:-1]})")
        elif k not in words:
            tests.append(_sql_term_hit("t", _sql_list([k])[1:-1]))
    return "(" + " OR ".join(tests) + ")"


@query("scope_filter", "P1 P2 U8 Q10 Q11", with_views(f"""
WITH tt AS MATERIALIZED (
  SELECT page_id, lower({_sql_strip("coalesce(title, '')")}) AS t FROM v_page),
tk AS MATERIALIZED (SELECT page_id, t, string_split_regex(t, '{_NW}') AS toks FROM tt),
sc AS MATERIALIZED (SELECT page_id, {_scope_sql(EXTRA_SCOPE_TERMS)} AS in_scope, {_scope_sql([])} AS in_default_scope FROM tk)
SELECT page_id, in_scope, in_default_scope, CAST(length(html) % 200 AS INTEGER) AS descendants,
  CAST(length(html) % 200 AS INTEGER) >= 50 AND in_scope AS passes
FROM sc JOIN pages USING (page_id)""", ["v_page"]))
def scope_filter(spark, sf):
    pages = T.table(spark, sf, "pages").select("page_id", (F.length("html") % 200)
                                                .cast("int").alias("descendants"))
    v = T.v_page(spark, sf).join(pages, "page_id")
    passed = ingest.story_filter(v, extra_terms=EXTRA_SCOPE_TERMS).select("page_id", F.lit(True).alias("passes"))
    return v.join(passed, "page_id", "left").select(
        "page_id", X.scope_match(F.col("title"), EXTRA_SCOPE_TERMS).alias("in_scope"),
        X.scope_match(F.col("title")).alias("in_default_scope"), "descendants",
        F.coalesce("passes", F.lit(False)).alias("passes"))


@query("target_entities", "P3 U6 Q9", with_views(f"""
SELECT page_id, e.terms AS entities FROM v_page
JOIN ({sql_target_entities('title', 'page_id', 'v_page')}) e ON e.k = page_id""", ["v_page"]))
def target_entities(spark, sf):
    v = T.v_page(spark, sf)
    return v.select("page_id", X.target_entities(F.col("title")).alias("entities"))


def _hyp_sql(terms: str) -> str:
    first = f"{_sql_strip(f'coalesce({terms}[1], {chr(39)}{chr(39)})')}"
    targeted = "[" + ", ".join(f"replace('{t}', '{{target}}', {first})"
                               for t in lexicon.TARGETED_TEMPLATES) + "]"
    generic = _sql_list(lexicon.GENERIC_TEMPLATES)
    return f"CASE WHEN {first} <> '' THEN {targeted} ELSE {generic} END"


@query("hypothesis_labels", "P19", with_views(f"""
SELECT page_id, {_hyp_sql('e.terms')} AS hypotheses FROM v_page
JOIN ({sql_target_entities('title', 'page_id', 'v_page')}) e ON e.k = page_id""", ["v_page"]))
def hypothesis_labels_q(spark, sf):
    v = T.v_page(spark, sf)
    return v.select("page_id", hypothesis_labels(X.target_entities(F.col("title")))
                    .alias("hypotheses"))


def _split_sql(raw: str) -> str:
    return (f"list_filter(list_transform(string_split(coalesce({raw}, ''), ','), "
            f"lambda t: {_sql_strip('t')}), lambda t: t <> '')")


@query("target_gate", "P4 P5 J7", with_views(f"""
WITH j AS (SELECT c.comment_id, c.post_id, c.body, {_split_sql('p.target_terms')} AS terms
           FROM v_comment c LEFT JOIN v_post p ON p.post_id = c.post_id)
SELECT comment_id, post_id, CAST(len(terms) AS INTEGER) AS n_terms,
  len(terms) = 0 OR list_bool_or(list_transform(terms, lambda t:
      {_sql_term_hit("lower(coalesce(body, ''))", 'lower(t)')})) AS on_target
FROM j""", ["v_comment", "v_post"]))
def target_gate(spark, sf):
    j = with_target_terms(T.v_comment(spark, sf).select("comment_id", "post_id", "body"), T.v_post(spark, sf))
    j = j.withColumn("terms", X.split_terms(F.col("target_terms")))
    return j.select("comment_id", "post_id", F.size("terms").alias("n_terms"),
                    X.on_target(F.col("body"), F.col("terms")).alias("on_target"))


@query("author_hash", "P9 P21", with_views("""
SELECT id, CASE WHEN nullif(by_, '') IS NULL THEN NULL ELSE sha256(by_) END AS author_hash,
  substr(CASE WHEN nullif(by_, '') IS NULL THEN NULL ELSE sha256(by_) END, 1, 8) AS author_tag
FROM (SELECT id, CASE WHEN turn % 4 = 3 THEN '' ELSE "by" END AS by_ FROM v_thread)""", ["v_thread"]))
def author_hash_q(spark, sf):
    """Authors of thread items; every 4th turn is an anonymous ('') author."""
    v = T.v_thread(spark, sf).select(
        "id", F.when(F.col("turn") % 4 == 3, F.lit("")).otherwise(F.col("by")).alias("by_"))
    h = X.author_hash(F.col("by_"))
    return v.select("id", h.alias("author_hash"), X.author_tag(h).alias("author_tag"))


@query("low_confidence", "E4 P6", with_views(f"""
SELECT comment_id,
  CAST(len(list_filter(regexp_split_to_array({_sql_strip("coalesce(body, '')")}, '[\\s\\p{{Z}}]+'),
       lambda w: w <> '')) AS INTEGER) AS n_words,
  len(list_filter(regexp_split_to_array({_sql_strip("coalesce(body, '')")}, '[\\s\\p{{Z}}]+'),
       lambda w: w <> '')) < 15 AS low_confidence,
  body IS NULL OR regexp_matches(body, '^[\\s\\p{{Z}}]*$') AS is_blank
FROM v_comment""", ["v_comment"]))
def low_confidence(spark, sf):
    c = T.v_comment(spark, sf)
    n = X.word_count(F.col("body"))
    return c.select("comment_id", n.alias("n_words"), (n < 15).alias("low_confidence"),
                    X.is_blank(F.col("body")).alias("is_blank"))


@query("topic_naming", "P7 P8", with_views(f"""
WITH t AS (SELECT page_id, substr(title, 1, {lexicon.TITLE_MAX}) AS title FROM v_page),
f AS (SELECT title, min(page_id) AS first_id FROM t GROUP BY title)
SELECT page_id, t.title,
  CASE WHEN page_id = f.first_id THEN t.title
       ELSE substr(t.title, 1, {lexicon.TITLE_COLLISION_PREFIX}) || ' (#' || CAST(page_id AS VARCHAR) || ')' END AS name,
  '{lexicon.PERMALINK_BASE}' || CAST(page_id AS VARCHAR) AS permalink
FROM t JOIN f USING (title)""", ["v_page"]))
def topic_naming(spark, sf):
    v = T.v_page(spark, sf)
    named = ingest.topic_names(v, "title", "page_id")
    return named.select("page_id", "title", "name",
                        X.permalink(F.col("page_id").cast("string")).alias("permalink"))
