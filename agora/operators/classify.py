"""Scorers and the classification job.

The pretrained models of the original service are not available; the
default scorers are lexicon rules written as Spark SQL expressions (map
lookups and array filters over the tokenised body), so they run inside the
JVM with no shuffle and no Python. They stand in for the models: they keep
the models' *contracts* (raw label + score, thresholds, failure defaults)
but make no claim about accuracy.

A different scorer plugs in through ``pandas_scorer``: a vectorised
function over Arrow batches run by ``mapInPandas``, applied only to the rows
that survive the gate (predicates cannot move through a Python map, so the
cheap filter is applied first, explicitly).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.scalar import sentiment_from_output, stance_from_index, toxicity_from_output
from agora.functions.text import is_blank, on_target, split_terms, word_tokens
from agora.operators.common import with_target_terms


def _weights_map(weights: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])


def lexicon_toxicity_output(tokens: Column, weights=None) -> tuple[Column, Column]:
    """Raw toxicity output (label, score) of the lexicon scorer.

    w = highest weight of any token; LABEL_1 with score w when w >= 0.5,
    else LABEL_0 with score 1 - w (a benign label, inverted by the M3
    contract)."""
    m = _weights_map(weights or lexicon.TOXIC_WEIGHTS)
    w = F.aggregate(tokens, F.lit(0.0),
                    lambda acc, t: F.greatest(acc, F.coalesce(F.try_element_at(m, t), F.lit(0.0))))
    label = F.when(w >= 0.5, F.lit("LABEL_1")).otherwise(F.lit("LABEL_0"))
    score = F.when(w >= 0.5, w).otherwise(F.lit(1.0) - w)
    return label, score


def polarity_counts(tokens: Column, positive=None, negative=None) -> Column:
    """struct(p, n): positive / negative lexicon hits, one pass over tokens."""
    m = F.create_map(*[x for w in (positive or lexicon.POSITIVE_WORDS)
                       for x in (F.lit(w), F.lit(1))],
                     *[x for w in (negative or lexicon.NEGATIVE_WORDS)
                       if w not in (positive or lexicon.POSITIVE_WORDS)
                       for x in (F.lit(w), F.lit(-1))])
    init = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"))

    def step(acc, t):
        v = F.try_element_at(m, t)
        return F.struct((acc["p"] + F.when(v == 1, 1).otherwise(0)).alias("p"),
                        (acc["n"] + F.when(v == -1, 1).otherwise(0)).alias("n"))

    return F.aggregate(tokens, init, step)


def lexicon_sentiment_output(pn: Column) -> tuple[Column, Column]:
    """Raw sentiment output: x = (pos - neg) / (pos + neg); label by sign,
    confidence 0.5 + |x| / 2; no hits -> ('NEUTRAL', 0)."""
    p, n = pn["p"], pn["n"]
    x = F.try_divide((p - n).cast("double"), (p + n).cast("double"))
    label = F.when(x > 0, "POSITIVE").when(x < 0, "NEGATIVE").otherwise("NEUTRAL")
    score = F.coalesce(F.lit(0.5) + F.abs(x) / 2, F.lit(0.0))
    return label, score


def lexicon_stance_index(pn: Column) -> Column:
    """Winning hypothesis index: only positive words -> 0 (supports), only
    negative -> 1 (opposes), both -> 2 (mixed), none -> 3 (unrelated)."""
    p, n = pn["p"], pn["n"]
    return (F.when((p > 0) & (n == 0), 0).when((n > 0) & (p == 0), 1)
            .when((p > 0) & (n > 0), 2).otherwise(3))


def score_columns(df: DataFrame, body: str = "body", skip: str | None = None) -> DataFrame:
    """Add stance / sentiment / toxicity of the default scorers.

    The body is tokenised once into a column; Spark keeps that projection
    separate (it does not inline an expensive expression used several
    times), so each text is scanned by the regex only once."""
    toks = word_tokens(F.col(body))
    if skip is not None:  # rows flagged ``skip`` are never tokenised
        toks = F.when(F.col(skip), F.array().cast("array<string>")).otherwise(toks)
    t = df.withColumn("_toks", toks).withColumn("_blank", is_blank(F.col(body)))
    t = t.withColumn("_pn", polarity_counts(F.col("_toks")))
    tl, ts = lexicon_toxicity_output(F.col("_toks"))
    sl, ss = lexicon_sentiment_output(F.col("_pn"))
    blank = F.col("_blank")
    return t.select(
        *df.columns,
        F.when(blank, F.lit("NEUTRAL")).otherwise(
            stance_from_index(lexicon_stance_index(F.col("_pn")))).alias("p_stance"),
        F.when(blank, F.lit("NEUTRAL")).otherwise(sentiment_from_output(sl, ss)).alias("p_sentiment"),
        F.when(blank, F.lit(0.0)).otherwise(toxicity_from_output(tl, ts)).alias("p_toxicity"))


def score_toxicity(body: Column) -> Column:
    """M3: toxicity in [0, 1]; blank text -> 0.0 without scoring."""
    label, score = lexicon_toxicity_output(word_tokens(body))
    return F.when(is_blank(body), F.lit(0.0)).otherwise(toxicity_from_output(label, score))


def score_sentiment(body: Column) -> Column:
    """M2: POSITIVE / NEUTRAL / NEGATIVE; blank text -> NEUTRAL."""
    label, score = lexicon_sentiment_output(polarity_counts(word_tokens(body)))
    return F.when(is_blank(body), F.lit("NEUTRAL")).otherwise(sentiment_from_output(label, score))


def score_stance(body: Column) -> Column:
    """M1: stance label by hypothesis index (Q7: index, not substring)."""
    return F.when(is_blank(body), F.lit("NEUTRAL")).otherwise(
        stance_from_index(lexicon_stance_index(polarity_counts(word_tokens(body)))))


def classify(comments: DataFrame, posts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """M5: classify every comment that has no classification yet.

    J1 anti join with ``existing``; J7 left join to the post's target terms;
    P5 gate. Off-target comments get NEUTRAL/NEUTRAL/0.0 by rule; the rest
    are scored ('model'). One projection with ``when`` instead of two
    branches and a union (U2). The gate is evaluated before any scorer.
    """
    todo = comments.where(F.col("body").isNotNull() & (F.col("body") != ""))
    if existing is not None:
        todo = todo.join(existing.select("comment_id"), "comment_id", "left_anti")
    j = with_target_terms(todo, posts)
    j = j.withColumn("_gated", ~on_target(F.col("body"), split_terms(F.col("target_terms"))))
    # one pass: gated rows skip tokenising and scoring (cheap before expensive)
    scored = score_columns(j.select("comment_id", "topic_id", "post_id", "body", "_gated"),
                           skip="_gated")
    gated = F.col("_gated")
    return scored.select(
        "comment_id", "topic_id", "post_id",
        F.when(gated, F.lit("NEUTRAL")).otherwise(F.col("p_stance")).alias("stance"),
        F.when(gated, F.lit("NEUTRAL")).otherwise(F.col("p_sentiment")).alias("sentiment"),
        F.when(gated, F.lit(0.0)).otherwise(F.col("p_toxicity")).alias("toxicity"),
        F.when(gated, F.lit("rule")).otherwise(F.lit("model")).alias("classified_by"))


def classify_metrics(classified: DataFrame) -> DataFrame:
    """Rows per classified_by (rule = gated, model = scored)."""
    return classified.groupBy("classified_by").agg(F.count(F.lit(1)).alias("n"))


def pandas_scorer(fn: Callable[[pd.Series], pd.DataFrame], out_schema: str,
                  text_col: str = "body", key: str = "comment_id"):
    """Wrap a vectorised scorer ``fn(texts) -> DataFrame`` for mapInPandas.

    ``fn`` gets a pandas Series of texts per Arrow batch and returns one row
    per text with the columns of ``out_schema`` (besides the key). A batch
    that raises is scored as failed: the caller's contract columns get
    NULLs, which the SQL contract maps to NEUTRAL / 0.0.
    """
    fields = [f.strip().split()[0] for f in out_schema.split(",")]

    def run(batches):
        for pdf in batches:
            try:
                res = fn(pdf[text_col]).reset_index(drop=True)
            except Exception:  # noqa: BLE001 - batch failure -> defaults
                res = pd.DataFrame({f: [None] * len(pdf) for f in fields})
            res.insert(0, key, pdf[key].reset_index(drop=True))
            yield res

    def apply(df: DataFrame) -> DataFrame:
        return df.select(key, text_col).mapInPandas(run, f"{key} long, {out_schema}")

    return apply
