"""Read-side report queries: timeline, comment explorer, topic overview,
coverage, gates (A2-A7, A12-A15, J1, J6, J11, J12, K1-K7, P13-P18).

Each is one DataFrame plan; the per-topic loops and N+1 lookups of a
request/response service become joins and aggregations over all topics.
Counts that accompany a page are scalar subqueries, not collects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora import lexicon
from agora.functions.scalar import safe_ratio
from agora.operators.rollup import STANCE_COLS

PCT_COLS = {"stance_support_count": "support_pct", "stance_oppose_count": "oppose_pct",
            "stance_mixed_count": "mixed_pct", "stance_neutral_count": "neutral_pct"}


def timeline(daily: DataFrame, topic_id=None, date_from=None, date_to=None) -> DataFrame:
    """P14/K6 + percentages: shares of the four stances (Q2: the denominator
    is their sum, not total_comments; Q3: 0 when that sum is 0)."""
    df = daily
    if topic_id is not None:
        df = df.where(F.col("topic_id") == topic_id)
    if date_from is not None:
        df = df.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.where(F.col("date") <= F.lit(date_to).cast("date"))
    four = sum((F.col(c) for c in STANCE_COLS.values()), F.lit(0))
    pcts = [safe_ratio(F.col(c), four).alias(p) for c, p in PCT_COLS.items()]
    return df.select("*", *pcts).orderBy("topic_id", "date")


def stance_breakdown(comments: DataFrame, classifications: DataFrame) -> DataFrame:
    """A2 (J5): per topic, count per stance, zero-filled for the four labels;
    unknown labels are kept as extra rows (Q2)."""
    counted = (classifications.join(comments.select("comment_id", "topic_id"), "comment_id")
               .groupBy("topic_id", "stance").agg(F.count(F.lit(1)).alias("n")))
    # zero-fill: each topic with the four labels via explode of a literal
    topics = counted.select("topic_id").distinct()
    zero = topics.select("topic_id", F.explode(F.array(*[F.lit(s) for s in lexicon.STANCES]))
                         .alias("stance"))
    out = zero.join(counted, ["topic_id", "stance"], "full_outer")
    return out.select("topic_id", "stance", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def stance_distribution(classifications: DataFrame) -> DataFrame:
    """Overall stance counts, descending."""
    return (classifications.groupBy("stance").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "stance"))


def comments_page(comments: DataFrame, classifications: DataFrame, topic_id,
                  stance=None, sentiment=None, toxicity_min=None, toxicity_max=None,
                  sort_by: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a topic's comments plus the total.

    Any filter switches to an inner join with classifications (Q6: then
    unclassified comments drop out); without filters unclassified comments
    show as NEUTRAL/NEUTRAL/0.0. All predicates go on one join (Q5).
    """
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset >= 0")
    base = comments.where(F.col("topic_id") == topic_id)
    filtered = any(v is not None for v in (stance, sentiment, toxicity_min, toxicity_max))
    cls = classifications.select("comment_id", "stance", "sentiment",
                                 F.col("toxicity").alias("toxicity_score"))
    if filtered:
        df = base.join(cls, "comment_id", "inner")
        if stance is not None:
            df = df.where(F.col("stance") == stance)
        if sentiment is not None:
            df = df.where(F.col("sentiment") == sentiment)
        if toxicity_min is not None:
            df = df.where(F.col("toxicity_score") >= toxicity_min)
        if toxicity_max is not None:
            df = df.where(F.col("toxicity_score") <= toxicity_max)
    else:
        df = base.join(cls, "comment_id", "left").select(
            *[c for c in base.columns],
            F.coalesce("stance", F.lit("NEUTRAL")).alias("stance"),
            F.coalesce("sentiment", F.lit("NEUTRAL")).alias("sentiment"),
            F.coalesce("toxicity_score", F.lit(0.0)).alias("toxicity_score"))
    key = {"newest": F.desc("created_utc"), "scored": F.desc("score"),
           "most_relevant": F.desc("score")}[sort_by]
    total = df.select(F.count(F.lit(1))).scalar()
    page = df.orderBy(key, F.asc("comment_id")).offset(offset).limit(limit)
    return page.select("comment_id", "body", "author_hash", "created_utc", "score",
                       "stance", "sentiment", "toxicity_score",
                       total.alias("total"))


def topic_overview(comments: DataFrame, posts: DataFrame,
                   classifications: DataFrame, search: str | None = None) -> DataFrame:
    """Per topic post and comment counts, classified
    count, newest comment time; each side is pre-aggregated before the join
    (never join both children first). Sorted by activity."""
    pc = posts.groupBy("topic_id").agg(F.count(F.lit(1)).alias("post_count"),
                                       F.min_by("title", "post_id").alias("name"))
    cc = comments.groupBy("topic_id").agg(F.count(F.lit(1)).alias("comment_count"),
                                          F.max("created_utc").alias("last_updated_utc"))
    kc = (comments.select("comment_id", "topic_id")
          .join(classifications.select("comment_id"), "comment_id", "left_semi")
          .groupBy("topic_id").agg(F.count(F.lit(1)).alias("classified_count")))
    out = (pc.join(cc, "topic_id", "full_outer").join(kc, "topic_id", "left")
           .select("topic_id", "name",
                   F.coalesce("post_count", F.lit(0)).cast("bigint").alias("post_count"),
                   F.coalesce("comment_count", F.lit(0)).cast("bigint").alias("comment_count"),
                   F.coalesce("classified_count", F.lit(0)).cast("bigint").alias("classified_count"),
                   "last_updated_utc"))
    if search:
        out = out.where(F.instr(F.lower("name"), search.lower()) > 0)
    return out.orderBy(F.desc("comment_count"), "topic_id")


def classification_coverage(comments: DataFrame, classifications: DataFrame) -> DataFrame:
    """Total, classified, pending, coverage % (1 dp, 0 if empty)."""
    joined = comments.select("comment_id").join(
        classifications.select("comment_id", F.lit(True).alias("_c")), "comment_id", "left")
    agg = joined.agg(F.count(F.lit(1)).alias("total_comments"),
                     F.count_if(F.col("_c").isNotNull()).alias("classified"))
    return agg.select(
        F.col("total_comments").cast("bigint").alias("total_comments"),
        F.col("classified").cast("bigint").alias("classified"),
        (F.col("total_comments") - F.col("classified")).cast("bigint").alias("pending"),
        F.round(safe_ratio(F.col("classified") * 100.0, F.col("total_comments")), 1)
        .alias("coverage_pct"))


def unclassified_backlog(comments: DataFrame, classifications: DataFrame) -> DataFrame:
    """Comments with a non-empty body and no classification yet."""
    return (comments.where(F.col("body").isNotNull() & (F.col("body") != ""))
            .join(classifications.select("comment_id"), "comment_id", "left_anti")
            .select("comment_id", "topic_id", "created_utc"))


def classified_gate(comments: DataFrame, classifications: DataFrame,
                    minimum: int = lexicon.MIN_CLASSIFIED_COMMENTS) -> DataFrame:
    """Per topic, classified count vs the minimum for clustering."""
    counted = (classifications.select("comment_id")
               .join(comments.select("comment_id", "topic_id"), "comment_id", "inner")
               .groupBy("topic_id").agg(F.count(F.lit(1)).alias("classified_comments")))
    topics = comments.select("topic_id").distinct()
    out = topics.join(counted, "topic_id", "left").select(
        "topic_id", F.coalesce("classified_comments", F.lit(0)).cast("bigint")
        .alias("classified_comments"))
    ok = F.col("classified_comments") >= minimum
    return out.select(
        "topic_id", "classified_comments",
        ok.alias("clustering_available"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("insufficient_data")).alias("reason"),
        F.lit(minimum).cast("bigint").alias("required"))


def recent_posts(posts: DataFrame, n: int = 10) -> DataFrame:
    """K7: the n most recent posts (top-k is the feature)."""
    return posts.orderBy(F.desc("created_utc"), F.desc("post_id")).limit(n)


def topic_by_id(topics: DataFrame, topic_id) -> DataFrame:
    """One topic by id (empty when it does not exist)."""
    return topics.where(F.col("topic_id") == topic_id)
