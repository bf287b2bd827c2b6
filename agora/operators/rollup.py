"""Daily and windowed stance / toxicity rollups.

The daily toxicity is deliberately *not* a plain mean: each stance group's
mean (over non-null scores) is weighted by the group's full row count, and
groups whose mean is NULL are left out of both sums. Both stages are hash
aggregations with map-side partial aggregation, so a hot topic or day never
lands whole in one task; the second stage only sees one row per
(topic, day, stance).

Toxicity is summed as whole billionths and stances are added in the order of
their names, so the result does not depend on the order of rows: a rerun, a
stream and a batch give the same number to the last digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora import lexicon

STANCE_COLS = {
    "SUPPORT": "stance_support_count",
    "OPPOSE": "stance_oppose_count",
    "MIXED": "stance_mixed_count",
    "NEUTRAL": "stance_neutral_count",
}


def comment_date(created_utc: Column) -> Column:
    """Epoch seconds -> UTC calendar date (session time zone pinned to UTC)."""
    return F.to_date(F.timestamp_seconds(created_utc))


#: Toxicity is summed in this fraction of one.
UNIT = 1_000_000_000


def units(toxicity: Column) -> Column:
    """A score in whole units, whose sum is exact in any order (scores beyond 9 digits are rounded)."""
    return F.round(toxicity * F.lit(float(UNIT))).cast("bigint")


def partials() -> list[Column]:
    """Stage one per stance: comments, toxicity in units and scored comments; they add up over any split."""
    return [F.count(F.lit(1)).alias("cnt"), F.sum(units(F.col("toxicity"))).alias("tox_units"),
            F.count("toxicity").alias("tox_n")]


def mean_of(sum_units: Column, n: Column) -> Column:
    """Mean score from a sum of units; null for none."""
    return F.try_divide(sum_units.cast("double"), n) / F.lit(float(UNIT))


def combine(per_stance: DataFrame, keys: list[str]) -> DataFrame:
    """Stage two over one row per (keys, stance) with ``partials``: stance counts and weighted toxicity."""
    aggs = [F.sum(F.when(F.col("stance") == s, F.col("cnt")).otherwise(F.lit(0)))
            .cast("bigint").alias(c) for s, c in STANCE_COLS.items()]
    term = F.try_divide(F.col("tox_units").cast("double"), F.col("tox_n")) * F.col("cnt")
    scored = F.col("tox_n") > 0
    aggs += [F.sum("cnt").cast("bigint").alias("total_comments"),
             F.sort_array(F.collect_list(F.when(scored, F.struct("stance", term.alias("term"))))).alias("terms"),
             F.sum(F.when(scored, F.col("cnt"))).alias("weight")]
    total = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["term"])
    out = per_stance.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *STANCE_COLS.values(), "total_comments",
                      (F.try_divide(total, F.col("weight")) / F.lit(float(UNIT))).alias("avg_toxicity"))


def _two_stage(df: DataFrame, keys: list[str]) -> DataFrame:
    return combine(df.groupBy(*keys, "stance").agg(*partials()), keys)


def daily_stats(classified: DataFrame) -> DataFrame:
    """A1: per (topic_id, date) stance counts, total and weighted toxicity.

    ``classified`` needs topic_id, created_utc, stance, toxicity.
    A stance outside the four labels adds to total only (Q2).
    """
    df = classified.select("topic_id", comment_date(F.col("created_utc")).alias("date"),
                           "stance", "toxicity")
    return _two_stage(df, ["topic_id", "date"])


def windowed_stats(classified: DataFrame, window: str = "6 hours",
                   history_days: int | None = None) -> DataFrame:
    """The same rollup over tumbling ``window`` buckets.

    With ``history_days`` only the last N days before the newest comment are
    kept (a scalar subquery, evaluated once, not a join).
    """
    ts = F.timestamp_seconds(F.col("created_utc"))
    df = classified
    if history_days is not None:
        newest = classified.select(F.max("created_utc")).scalar()
        df = df.where(F.col("created_utc") >= newest - F.lit(history_days * 86400))
    df = df.select("topic_id", F.window(ts, window).start.alias("bucket_start"),
                   "stance", "toxicity")
    return _two_stage(df, ["topic_id", "bucket_start"])


def toxicity_by_stance_window(classified: DataFrame, window: str = "1 day") -> DataFrame:
    """Mean toxicity and counts per stance and time window."""
    ts = F.timestamp_seconds(F.col("created_utc"))
    return (classified.groupBy(F.window(ts, window).start.alias("bucket_start"), "stance")
            .agg(F.count(F.lit(1)).alias("n_comments"),
                 F.count("toxicity").alias("n_scored"),
                 mean_of(F.sum(units(F.col("toxicity"))), F.count("toxicity")).alias("avg_toxicity")))


def upsert_daily_stats(existing: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Keyed merge on (topic_id, date).

    Rows of keys that were recomputed are replaced; every other existing row
    (other topics, other days) survives. Anti join + union, no partition
    overwrite.
    """
    kept = existing.join(recomputed.select("topic_id", "date"),
                         ["topic_id", "date"], "left_anti")
    return kept.unionByName(recomputed)


def active_topics_only(df: DataFrame, topics: DataFrame) -> DataFrame:
    """Restrict to topics whose status is 'active' (left-semi join)."""
    return df.join(topics.where(F.col("status") == "active").select("topic_id"),
                   "topic_id", "left_semi")
