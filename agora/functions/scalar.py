"""Scalar helpers: safe ratios, clamps, label contracts, rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora import lexicon


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, 0 when den is 0 or NULL (ANSI mode would raise on /0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double")))


def toxicity_from_output(label: Column, score: Column) -> Column:
    """M3 contract: probability of 'toxic' from a (label, score) output.

    A toxic label keeps its score, any other label is inverted; the result is
    clamped to [0, 1]. Missing score counts as 0.
    """
    lab = F.upper(F.coalesce(label, F.lit("")))
    s = F.coalesce(score.cast("double"), F.lit(0.0))
    prob = F.when(lab.isin(*lexicon.TOXIC_LABELS), s).otherwise(F.lit(1.0) - s)
    return clamp01(prob)


def toxicity_tier(score: Column) -> Column:
    """low < 0.3 <= medium < 0.7 <= high."""
    expr = None
    for threshold, name in lexicon.TOXICITY_TIERS:
        expr = (F.when(score >= threshold, F.lit(name)) if expr is None
                else expr.when(score >= threshold, F.lit(name)))
    return expr.otherwise(F.lit("low"))


def sentiment_from_output(label: Column, score: Column,
                          threshold: float = lexicon.SENTIMENT_THRESHOLD) -> Column:
    """M2 contract: raw (label, score) -> POSITIVE / NEUTRAL / NEGATIVE."""
    lab = F.upper(F.coalesce(label, F.lit("")))
    mapped = None
    for raw, canon in lexicon.SENTIMENT_LABEL_MAP.items():
        mapped = (F.when(lab == raw, F.lit(canon)) if mapped is None
                  else mapped.when(lab == raw, F.lit(canon)))
    mapped = mapped.otherwise(F.lit("NEUTRAL"))
    return F.when(F.coalesce(score.cast("double"), F.lit(0.0)) < threshold,
                  F.lit("NEUTRAL")).otherwise(mapped)


def stance_from_index(idx: Column, labels: Sequence[str] = lexicon.STANCES) -> Column:
    """Stance label of the winning hypothesis (by index, not by substring)."""
    arr = F.array(*[F.lit(s) for s in labels])
    return F.coalesce(F.try_element_at(arr, (idx + 1).cast("int")), F.lit("NEUTRAL"))


def hypothesis_labels(terms: Column) -> Column:
    """The four hypotheses, filled with the first target term."""
    primary = py_strip_first(terms)
    targeted = F.array(*[F.replace(F.lit(t), F.lit("{target}"), primary)
                         for t in lexicon.TARGETED_TEMPLATES])
    generic = F.array(*[F.lit(t) for t in lexicon.GENERIC_TEMPLATES])
    return F.when(F.coalesce(primary, F.lit("")) != "", targeted).otherwise(generic)


def py_strip_first(terms: Column) -> Column:
    from agora.functions.text import py_strip
    return py_strip(F.coalesce(F.try_element_at(terms, F.lit(1)), F.lit("")))


def round6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def half_up(x: Column, digits: int) -> Column:
    """Rounds a non-negative double by plain arithmetic, which gives the same number in every engine."""
    return F.floor(x * F.lit(float(10 ** digits)) + F.lit(0.5)).cast("double") / F.lit(float(10 ** digits))


def iso_utc(epoch: Column) -> Column:
    """Epoch seconds -> ISO 8601 in UTC with a Z, e.g. 2024-01-01T00:00:00Z (session zone UTC)."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_label(day: Column) -> Column:
    """Date -> short label of a chart's axis, e.g. Jan 5."""
    return F.date_format(day, "MMM d")


def percent(share: Column, digits: int = 1) -> Column:
    """Share in [0, 1] -> percent text, e.g. 0.125 -> 12.5%; NULL stays NULL."""
    return F.concat(F.format_string(f"%.{digits}f", F.round(share * 100, digits)), F.lit("%"))
