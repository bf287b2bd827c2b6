"""Catalogue: scorers, classification job, evaluation, keywords, embeddings
(M1-M5, M8, A9, A16-A21, J1, J2, K8, S13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.scalar import round6, toxicity_tier
from agora.operators import classify as C
from agora.operators import embed as E
from agora.operators import evaluate as V
from agora.operators import keywords as K
from agora.plans.registry import query
from agora.plans.textops import _split_sql, _sql_term_hit
from agora.sources import tables as T
from agora.sources.tables import _sql_list, with_views

_TOKS = "regexp_extract_all(lower(coalesce({b}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_BLANK = "({b} IS NULL OR regexp_matches({b}, '^[\\s\\p{{Z}}]*$'))"


def _tox_sql(b: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicon.TOXIC_WEIGHTS.items())
    w = (f"coalesce(list_max(list_transform({_TOKS.format(b=b)}, "
         f"lambda t: CASE t {cases} ELSE 0.0 END)), 0.0)")
    return f"CASE WHEN {_BLANK.format(b=b)} THEN 0.0 ELSE CAST({w} AS DOUBLE) END"


def _pn_sql(b: str):
    toks = _TOKS.format(b=b)
    p = f"len(list_filter({toks}, lambda t: list_contains({_sql_list(lexicon.POSITIVE_WORDS)}, t)))"
    n = f"len(list_filter({toks}, lambda t: list_contains({_sql_list(lexicon.NEGATIVE_WORDS)}, t)))"
    return p, n


def _sent_sql(b: str) -> str:
    p, n = _pn_sql(b)
    x = f"(({p}) - ({n})) / nullif(({p}) + ({n}), 0)"
    conf = f"coalesce(0.5 + abs({x}) / 2, 0.0)"
    lab = f"CASE WHEN {x} > 0 THEN 'POSITIVE' WHEN {x} < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END"
    return (f"CASE WHEN {_BLANK.format(b=b)} THEN 'NEUTRAL' WHEN {conf} < 0.85 THEN 'NEUTRAL' "
            f"ELSE {lab} END")


def _stance_sql(b: str) -> str:
    p, n = _pn_sql(b)
    return (f"CASE WHEN {_BLANK.format(b=b)} THEN 'NEUTRAL' "
            f"WHEN ({p}) > 0 AND ({n}) = 0 THEN 'SUPPORT' WHEN ({n}) > 0 AND ({p}) = 0 THEN 'OPPOSE' "
            f"WHEN ({p}) > 0 AND ({n}) > 0 THEN 'MIXED' ELSE 'NEUTRAL' END")


@query("toxicity_score", "M3 tier", with_views(f"""
SELECT comment_id, round({_tox_sql('body')}, 6) AS toxicity,
  CASE WHEN {_tox_sql('body')} >= 0.7 THEN 'high' WHEN {_tox_sql('body')} >= 0.3 THEN 'medium'
       ELSE 'low' END AS tier
FROM v_comment""", ["v_comment"]))
def toxicity_score(spark, sf):
    c = C.score_columns(T.v_comment(spark, sf).select("comment_id", "body"))
    s = F.col("p_toxicity")
    return c.select("comment_id", round6(s).alias("toxicity"), toxicity_tier(s).alias("tier"))


@query("sentiment_label", "M2", with_views(f"""
SELECT comment_id, {_sent_sql('body')} AS sentiment FROM v_comment""", ["v_comment"]))
def sentiment_label(spark, sf):
    c = C.score_columns(T.v_comment(spark, sf).select("comment_id", "body"))
    return c.select("comment_id", F.col("p_sentiment").alias("sentiment"))


@query("stance_label", "M1 P19 Q7", with_views(f"""
SELECT comment_id, {_stance_sql('body')} AS stance FROM v_comment""", ["v_comment"]))
def stance_label(spark, sf):
    c = C.score_columns(T.v_comment(spark, sf).select("comment_id", "body"))
    return c.select("comment_id", F.col("p_stance").alias("stance"))


_CLASSIFY_SQL = f"""
WITH todo AS (SELECT * FROM v_comment c WHERE body IS NOT NULL AND body <> ''
              AND NOT EXISTS (SELECT 1 FROM v_comment_class k WHERE k.comment_id = c.comment_id)),
j AS (SELECT t.*, {_split_sql('p.target_terms')} AS terms FROM todo t LEFT JOIN v_post p USING (post_id)),
g AS (SELECT *, NOT (len(terms) = 0 OR list_bool_or(list_transform(terms, lambda t:
      {_sql_term_hit("lower(coalesce(body, ''))", 'lower(t)')}))) AS gated FROM j)
SELECT comment_id, topic_id, post_id,
  CASE WHEN gated THEN 'NEUTRAL' ELSE {_stance_sql('body')} END AS stance,
  CASE WHEN gated THEN 'NEUTRAL' ELSE {_sent_sql('body')} END AS sentiment,
  round(CASE WHEN gated THEN 0.0 ELSE {_tox_sql('body')} END, 6) AS toxicity,
  CASE WHEN gated THEN 'rule' ELSE 'model' END AS classified_by
FROM g"""


def _classified(spark, sf):
    out = C.classify(T.v_comment(spark, sf), T.v_post(spark, sf), T.v_comment_class(spark, sf))
    return out.withColumn("toxicity", round6(F.col("toxicity")))


@query("classify_job", "M5 U2 J1 J7 P5", with_views(_CLASSIFY_SQL,
                                                      ["v_comment", "v_post", "v_comment_class"]))
def classify_job(spark, sf):
    return _classified(spark, sf)


@query("classify_metrics", "A9", with_views(f"""
WITH r AS ({_CLASSIFY_SQL}) SELECT classified_by, count(*) AS n FROM r GROUP BY ALL""",
                                             ["v_comment", "v_post", "v_comment_class"]))
def classify_metrics(spark, sf):
    return C.classify_metrics(_classified(spark, sf))


def _labelled(spark, sf):
    c = T.v_comment(spark, sf).join(T.v_label(spark, sf), "comment_id")
    return c


_LABELLED = """SELECT c.comment_id, c.body, l.quality, l.toxic FROM v_comment c
JOIN v_label l USING (comment_id)"""


def _tox_pairs(spark, sf):
    c = C.score_columns(_labelled(spark, sf))
    return c.select(F.when(F.col("toxic") == 1, "TOXIC").otherwise("CLEAN").alias("y_true"),
                    F.when(F.col("p_toxicity") >= 0.5, "TOXIC").otherwise("CLEAN").alias("y_pred"))


def _task_pairs(spark, sf):
    """(task, y_true, y_pred) of the three tasks; every labelled comment is scored once."""
    c = C.score_columns(_labelled(spark, sf))
    sentiment = (F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "POSITIVE")
                 .otherwise("NEUTRAL"))
    stance = F.element_at(F.array(*[F.lit(s) for s in lexicon.STANCES]), (F.col("comment_id") % 4 + 1).cast("int"))

    def pair(task, true, pred):
        return F.struct(F.lit(task).alias("task"), true.alias("y_true"), pred.alias("y_pred"))
    return c.select(F.explode(F.array(
        pair("stance", stance, F.col("p_stance")), pair("sentiment", sentiment, F.col("p_sentiment")),
        pair("toxicity", F.when(F.col("toxic") == 1, "TOXIC").otherwise("CLEAN"),
             F.when(F.col("p_toxicity") >= 0.5, "TOXIC").otherwise("CLEAN")))).alias("p")).select("p.*")


_PAIRS_SQL = f"""
lab AS ({_LABELLED}),
tox AS (SELECT CASE WHEN toxic = 1 THEN 'TOXIC' ELSE 'CLEAN' END AS y_true,
               CASE WHEN {_tox_sql('body')} >= 0.5 THEN 'TOXIC' ELSE 'CLEAN' END AS y_pred FROM lab),
sen AS (SELECT CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS y_true,
               {_sent_sql('body')} AS y_pred FROM lab),
sta AS (SELECT {_sql_list(lexicon.STANCES)}[comment_id % 4 + 1] AS y_true, {_stance_sql('body')} AS y_pred FROM lab)"""


@query("confusion_matrix", "A16 U3", with_views(f"""
WITH {_PAIRS_SQL}
SELECT y_true, y_pred, count(*) AS n FROM tox GROUP BY ALL""", ["v_comment", "v_label"]))
def confusion_matrix(spark, sf):
    return V.confusion(_tox_pairs(spark, sf))


def _report_sql(pairs: str, task: str) -> str:
    return f"""
(WITH cm AS (SELECT y_true, y_pred, count(*) AS n FROM {pairs} GROUP BY ALL),
labels AS (SELECT y_true AS label FROM {pairs} UNION SELECT y_pred FROM {pairs}),
per AS (SELECT label,
   coalesce((SELECT sum(n) FROM cm WHERE y_true = label AND y_pred = label), 0) AS tp,
   coalesce((SELECT sum(n) FROM cm WHERE y_pred = label AND y_true <> label), 0) AS fp,
   coalesce((SELECT sum(n) FROM cm WHERE y_true = label AND y_pred <> label), 0) AS fn
   FROM labels),
pr AS (SELECT label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
   coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM per),
pf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr),
mi AS (SELECT coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0.0) AS p,
   coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0.0) AS r FROM pf),
acc AS (SELECT coalesce(count(*) FILTER (WHERE y_true = y_pred) / nullif(count(*), 0), 0.0) AS a FROM {pairs})
SELECT *, (SELECT count(*) FROM {pairs}) AS n_evaluated FROM (
SELECT '{task}' AS task, 'class' AS kind, label, round(precision, 4) AS precision,
   round(recall, 4) AS recall, round(f1, 4) AS f1 FROM pf
UNION ALL SELECT '{task}', 'macro', 'macro', round(avg(precision), 4), round(avg(recall), 4),
   round(avg(f1), 4) FROM pf
UNION ALL SELECT '{task}', 'micro', 'micro', round(p, 4), round(r, 4),
   round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 4) FROM mi
UNION ALL SELECT '{task}', 'accuracy', 'accuracy', round(a, 4), round(a, 4), round(a, 4) FROM acc))"""


@query("classifier_report", "A17 A18 U3 M11", with_views(f"""
WITH {_PAIRS_SQL}
SELECT * FROM {_report_sql('tox', 'toxicity')}
UNION ALL SELECT * FROM {_report_sql('sen', 'sentiment')}
UNION ALL SELECT * FROM {_report_sql('sta', 'stance')}""", ["v_comment", "v_label"]))
def classifier_report(spark, sf):
    return V.classification_reports(_task_pairs(spark, sf))


@query("toxicity_mae", "A19 A20", with_views(f"""
WITH lab AS ({_LABELLED})
SELECT count(*) AS n, round(avg(abs(toxic * 3 / 3.0 - {_tox_sql('body')})), 4) AS mae FROM lab""",
                                              ["v_comment", "v_label"]))
def toxicity_mae(spark, sf):
    c = C.score_columns(_labelled(spark, sf))
    pairs = c.select((F.col("toxic") * 3).alias("label"), F.col("p_toxicity").alias("score"))
    return V.toxicity_mae(pairs)


@query("toxicity_model", "M3 (Spark ML logistic regression on labels)")
def toxicity_model(spark, sf):
    """A trained alternative scorer: HashingTF + LogisticRegression fitted on
    the labelled comments, applied to every comment (rows-only check)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    from agora.functions.text import word_tokens
    c = T.v_comment(spark, sf).select("comment_id", word_tokens(F.col("body")).alias("tokens"))
    train = c.join(T.v_label(spark, sf), "comment_id").select(
        "tokens", F.col("toxic").cast("double").alias("label"))
    model = Pipeline(stages=[HashingTF(inputCol="tokens", outputCol="features", numFeatures=1 << 12),
                             LogisticRegression(maxIter=20, regParam=0.01)]).fit(train)
    pred = model.transform(c)
    prob = vector_to_array(F.col("probability"))[1]
    return pred.select("comment_id", round6(prob).alias("toxicity"))


@query("labelling_sample", "K8 J10 S13", with_views("""
SELECT c.comment_id AS id, c.external_id, c.topic_id, c.post_id, coalesce(p.target_terms, '') AS target_terms, c.body,
  '' AS stance, '' AS sentiment, '' AS toxicity, '' AS notes
FROM v_comment c JOIN v_post p USING (post_id) WHERE c.body IS NOT NULL AND c.body <> ''
ORDER BY md5('42:' || CAST(c.comment_id AS VARCHAR)), c.comment_id LIMIT 200""", ["v_comment", "v_post"]))
def labelling_sample(spark, sf):
    """Seeded sample of 200 eligible comments with blank label columns."""
    return V.labelling_sample(T.v_comment(spark, sf), T.v_post(spark, sf), 200, seed=42)


def _docs(spark, sf):
    return T.v_comment(spark, sf).select(F.col("comment_id").alias("doc_id"), "topic_id",
                                         F.col("body").alias("text"))




def _stop_sql():
    return _sql_list(lexicon.english_stop_words())


@query("keywords_tf", "A21 U7", with_views(f"""
WITH toks AS (
  SELECT topic_id AS g, comment_id AS doc_id,
         unnest(regexp_extract_all(lower(coalesce(body, '')), '[a-z]{{2,}}')) AS term,
         generate_subscripts(regexp_extract_all(lower(coalesce(body, '')), '[a-z]{{2,}}'), 1) - 1 AS pos
  FROM v_comment),
c AS (SELECT g, term, count(*) AS cnt, min(doc_id * 100000000 + pos) AS first FROM toks
      WHERE NOT list_contains({_sql_list(list(lexicon.english_stop_words()) + lexicon.KEYWORD_EXTRA_STOP)}, term)
      GROUP BY ALL)
SELECT g AS topic_id, CAST(rank AS INTEGER) AS rank, term, CAST(cnt AS DOUBLE) AS score, 'tf' AS method
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cnt DESC, first) AS rank FROM c)
WHERE rank <= 8""", ["v_comment"]))
def keywords_tf(spark, sf):
    return K.tf_keywords(_docs(spark, sf), "topic_id")


_TFIDF_SQL = f"""
WITH d AS (SELECT topic_id AS g, comment_id AS doc_id,
             list_filter(regexp_extract_all(lower(coalesce(body, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'),
                         lambda t: NOT list_contains({_stop_sql()}, t)) AS uni FROM v_comment),
t AS (SELECT g, doc_id, unnest(list_concat(uni, list_transform(range(1, len(uni)),
                          lambda i: uni[i] || ' ' || uni[i + 1]))) AS term FROM d),
tf AS (SELECT g, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
nd AS (SELECT g, count(*) AS n_docs FROM d GROUP BY g),
st AS (SELECT g, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL),
voc AS (SELECT s.g, term, n_docs, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf
        FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cf DESC, term) AS r FROM st) s
        JOIN nd USING (g) WHERE {{cut}}),
w AS (SELECT tf.g, doc_id, term, n_docs, tf * idf AS w FROM tf JOIN voc USING (g, term)),
nw AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY g, doc_id)) AS norm FROM w),
sc AS (SELECT g, term, round(sum(w / norm) / any_value(n_docs), 9) AS score FROM nw GROUP BY ALL),
k AS (SELECT * FROM sc WHERE NOT list_has_any(string_split(term, ' '), {_sql_list(lexicon.KEYWORD_EXTRA_STOP)}))
SELECT g AS topic_id, CAST(rank AS INTEGER) AS rank, term, score, 'tfidf' AS method
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term DESC) AS rank FROM k)
WHERE rank <= 8"""


@query("keywords_tfidf", "M8 W4, 500 features", with_views(_TFIDF_SQL.format(cut="r <= 500"), ["v_comment"]))
def keywords_tfidf(spark, sf):
    return K.tfidf_keywords(_docs(spark, sf), "topic_id", max_features=lexicon.TFIDF_MAX_FEATURES)


@query("keywords_tfidf_all", "M8 W4", with_views(_TFIDF_SQL.format(cut="true"), ["v_comment"]))
def keywords_tfidf_all(spark, sf):
    return K.tfidf_keywords(_docs(spark, sf), "topic_id")


@query("keywords_by_topic_lang", "M8 A21 dispatch (< 3 docs -> term frequency), 500 features")
def keywords_by_topic_lang(spark, sf):
    d = T.v_comment(spark, sf).select(F.concat_ws("/", F.col("topic_id").cast("string"), "lang").alias("group_key"),
                                      F.col("comment_id").alias("doc_id"), F.col("body").alias("text"))
    return K.keywords(d, "group_key",
                      max_features=lexicon.TFIDF_MAX_FEATURES)


@query("embed_comments", "M4 S12")
def embed_comments(spark, sf):
    emb = E.embed(T.v_comment(spark, sf).select("comment_id", "body"))
    return E.persistable(emb)


@query("unembedded_backlog", "J2 K9", with_views("""
SELECT comment_id, topic_id FROM v_comment c WHERE body IS NOT NULL AND body <> ''
  AND comment_id NOT IN (SELECT comment_id FROM v_vector)""", ["v_comment", "v_vector"]))
def unembedded_backlog(spark, sf):
    return E.unembedded(T.v_comment(spark, sf), T.v_vector(spark, sf)).select(
        "comment_id", "topic_id")
