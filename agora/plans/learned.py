"""Catalogue: models learned from the tables (M1, M2, M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.scalar import round6
from agora.operators import embed, lsa, polarity, stance
from agora.operators.common import with_target_terms
from agora.plans.registry import query
from agora.sources import tables as T
from agora.sources.tables import with_views

ROUNDS = 4


def _lexicon_sql(rounds: int) -> str:
    seeds = ", ".join([f"('{w}', 1.0)" for w in lexicon.POSITIVE_SEEDS] + [f"('{w}', -1.0)" for w in lexicon.NEGATIVE_SEEDS])
    steps = "".join(f""",
s{i + 1} AS MATERIALIZED (
  SELECT b.word, coalesce(b.seed, m.mean, 0.0) AS score FROM base b LEFT JOIN (
    SELECT e.word, sum(e.share * s.score) AS mean FROM edges e JOIN s{i} s ON s.word = e.neighbour
    GROUP BY e.word) m ON m.word = b.word)""" for i in range(rounds))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid,
             regexp_extract_all(lower(coalesce(body, '')), '[\p{{L}}\p{{N}}_]+') AS words FROM v_comment),
t AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
f AS (SELECT word, lead(word, 1) OVER w AS next1, lead(word, 2) OVER w AS next2 FROM t
      WINDOW w AS (PARTITION BY rid ORDER BY pos)),
p AS MATERIALIZED (
  SELECT least(word, other) AS a, greatest(word, other) AS b, count(*) AS n
  FROM (SELECT word, next1 AS other FROM f UNION ALL SELECT word, next2 FROM f)
  WHERE word <> other GROUP BY ALL HAVING count(*) >= 2),
ways AS (SELECT a AS word, b AS neighbour, n FROM p UNION ALL SELECT b, a, n FROM p),
met AS MATERIALIZED (SELECT word, sum(n) AS met FROM ways GROUP BY word),
weighted AS MATERIALIZED (
  SELECT w.word, w.neighbour, ln(CAST(n AS DOUBLE) * CAST((SELECT sum(met) FROM met) AS DOUBLE)
                                 / (CAST(x.met AS DOUBLE) * CAST(y.met AS DOUBLE))) AS weight
  FROM ways w JOIN met x ON x.word = w.word JOIN met y ON y.word = w.neighbour),
edges AS MATERIALIZED (
  SELECT word, neighbour, weight / sum(weight) OVER (PARTITION BY word) AS share FROM weighted WHERE weight > 0),
seeds(word, seed) AS (VALUES {seeds}),
base AS MATERIALIZED (
  SELECT word, seed FROM (SELECT DISTINCT word FROM edges) FULL JOIN seeds USING (word)),
s0 AS (SELECT word, coalesce(CAST(seed AS DOUBLE), 0.0) AS score FROM base){steps}
SELECT word, round(CAST(score AS DOUBLE), 6) + 0.0 AS score FROM s{rounds}"""


@query("sentiment_lexicon", f"M2, {ROUNDS} rounds over the words' graph", with_views(_lexicon_sql(ROUNDS), ["v_comment"]))
def sentiment_lexicon(spark, sf):
    learned = polarity.learn(T.v_comment(spark, sf), rounds=ROUNDS)
    return learned.select("word", (round6(F.col("score")) + 0.0).alias("score"))


@query("sentiment_learned", "M2, lexicon learned until it settles, over all comments")
def sentiment_learned(spark, sf):
    comments = polarity.Texts(T.v_comment(spark, sf).select("comment_id", "body"), "comment_id")
    return polarity.score(comments, polarity.learn(comments))


@query("stance_targeted", "M1, multinomial model of crossed text and target features")
def stance_targeted(spark, sf):
    """Learned from the classified comments whose crc32 of the id is not 0 modulo 5, applied to all comments."""
    comments = with_target_terms(T.v_comment(spark, sf).select("comment_id", "post_id", "body"), T.v_post(spark, sf))
    held_out = F.crc32(F.col("comment_id").cast("string")) % 5 == 0
    known = comments.join(T.v_comment_class(spark, sf).select("comment_id", "stance"), "comment_id")
    model = stance.fit(known.where(~held_out))
    return model.predict(comments).select("comment_id", "stance", held_out.alias("held_out"))


@query("embed_svd", "M4 S12, truncated SVD of the TF-IDF matrix")
def embed_svd(spark, sf):
    comments = T.v_comment(spark, sf).select("comment_id", "body")
    return embed.persistable(lsa.embed(comments, lsa.fit(comments)))
