"""Quality rules: base statistics of whole texts, and robust multivariate outliers per group.

Base statistics are counts over the whole text (see ``text_stats``); a text
fails the base rules with too few words or too much of it in repeated
three-word windows. The other verdict compares a text's transformed statistic
vector with a minimum-covariance-determinant (MCD) estimate of its language
and source, and rejects it by its Mahalanobis distance.

The MCD estimate. Each distinct vector of a group counts once, so copies carry
no weight. From two starts (coordinate medians and MADs, with Euclidean and
with maximum distance) two concentration steps each take the ``support`` share
of vectors nearest to the present centre, and their mean and covariance as the
next; the start with the smaller determinant goes on until no group's log
determinant falls by more than ``tolerance``. Its covariance is scaled by the
median distance, one reweighting step follows, and an estimate from n vectors
is drawn to the one of its whole language as by ``prior`` further vectors (and
that one to the one of all texts), so a group of any size has an estimate. A floor
on each variance keeps a statistic that is constant in clean text from
rejecting everything else.

The cutoff. Squared distances have longer tails than a normal sample's, so the
chi-square quantile would reject clean texts. A text is an outlier if the modified
z-score of its log squared distance (median and MAD over the table's distinct
vectors that pass the base rules) is above ``outlier_z``, 3.5 by convention; no label is used. Distances
within the chi-square 0.975 quantile are never outliers.

Every step is one aggregation over the vectors, with partial sums before the
shuffle, and a join to one row per group; a group is never collected.

Null or empty text: 0 words, so it fails the base rules. Null language or
source: a group of its own. Repeated rows are judged alike; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from agora.llm.common import map_batches, map_rows, prepare, strings

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = b"!\"'(),-./:;=?@[\\]^_`{}~+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
STAT_SCHEMA = ("doc_id long, lang string, source string, "
               + ", ".join(f"{c} long" for c in STATS))


def repeat_words(words: list[str]) -> int:
    """Words in three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(count[window] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 3, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The counts of STATS over the whole text."""
    words = _WORDS(text)
    lines = [x for x in text.split("\n") if _WORDS(x)] if "\n" in text else []
    data = text.encode()
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(words), len(data) - len(data.translate(None, _UPPER)),
            len(data) - len(data.translate(None, _MARKS)))


def document_stats(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATS of every row."""
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [text_stats(t) for t in strings(batch.column("text"))]
            columns = list(zip(*rows)) if rows else [[]] * len(STATS)
            return pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "lang", "source", *STATS])
        return run
    kept = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                            F.col("source").cast("string").alias("source"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(kept, make, STAT_SCHEMA)


@dataclass(frozen=True)
class Settings:
    support: float = 0.75       # share of a group's vectors in its subset
    tolerance: float = 0.01     # of the log determinant
    prior: float = 40.0         # vectors' worth of the wider group's estimate
    outlier_z: float = 3.5      # largest modified z-score of a log squared distance that is kept
    floors: tuple[float, ...] = (0.5, 0.05, 0.15, 0.15, 0.1, 0.15, 0.15)  # least standard deviations


def vector_columns() -> list[Column]:
    """The transformed statistics: log length, and compressed shares of the other counts."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")), F.log(chars / words),
            F.log1p(10 * F.col("n_symbols") / words), F.log1p(F.col("n_dup_lines").cast("double")),
            F.asin(F.sqrt(F.col("n_repeat_words") / words)),
            F.log1p(10 * F.col("n_upper") / words), F.log1p(10 * F.col("n_marks") / words)]


D = len(STATS)
X = [f"x{i}" for i in range(D)]
KEY = ["g_lang", "g_source"]
ALL = "\x00all"
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


#: Groups up to which their estimates are broadcast (about 0.6 KB each); beyond it Spark joins as it sees fit.
BROADCAST_ROWS = 20_000


def distance(mean: str = "mean", precision: str = "precision") -> Column:
    """Squared Mahalanobis distance of X under the joined estimate."""
    c = [F.col(x) - F.col(mean)[i] for i, x in enumerate(X)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + F.col(precision)[k] * c[i] * c[j] * (1 if i == j else 2)
    return total


def _estimates(moments: DataFrame, keys: list[str], floors: tuple[float, ...], extra: str = "") -> DataFrame:
    """From (keys, n, sums, products): n, mean, cov and log determinant, one row a group."""
    floor = np.diag(np.square(floors))

    def run(batches):
        for pdf in batches:
            mean, cov, prec, logdet = [], [], [], []
            for n, s, p in zip(pdf["n"], pdf["sums"], pdf["products"]):
                m = np.asarray(s, float) / n
                c = np.zeros((D, D))
                for (i, j), v in zip(PAIRS, p):
                    c[i, j] = c[j, i] = v / n - m[i] * m[j]
                # variances are raised to the floor, and a hundredth of it keeps few points invertible
                c = c + np.diag(np.maximum(np.diag(floor) - np.diag(c), 0.0)) + 0.01 * floor
                mean.append(m)
                cov.append([c[i, j] for i, j in PAIRS])
                prec.append([q[i, j] for q in [np.linalg.inv(c)] for i, j in PAIRS])
                logdet.append(np.linalg.slogdet(c)[1])
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "n": pdf["n"], "mean": mean, "cov": cov,
                                "precision": prec, "logdet": logdet})
    kinds = dict(moments.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return moments.mapInPandas(run, f"{schema}, n double, mean array<double>, cov array<double>, "
                                    "precision array<double>, logdet double")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and products of X per group."""
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.array(*[F.sum(x) for x in X]).alias("sums"),
        F.array(*[F.sum(F.col(X[i]) * F.col(X[j])) for i, j in PAIRS]).alias("products"))
    return sums


def fit(stats: DataFrame, s: Settings = Settings(), min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """(g_lang, g_source, mean, precision, cutoff): the estimate of every group, already drawn to the
    wider ones, and the largest squared distance that is kept (the same for all groups)."""
    prepare(stats.sparkSession)
    vectors = (stats.select(F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"),
                            *[v.alias(x) for v, x in zip(vector_columns(), X)]).distinct())
    levels = F.array(F.struct(F.col("l").alias("g_lang"), F.col("s").alias("g_source")),
                     F.struct(F.col("l").alias("g_lang"), F.lit(ALL).alias("g_source")),
                     F.struct(F.lit(ALL).alias("g_lang"), F.lit(ALL).alias("g_source")))
    rows = vectors.select(F.explode(levels).alias("g"), *X).select("g.*", *X).checkpoint()

    center = rows.groupBy(*KEY).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(X)]).checkpoint()
    few = center.count() <= BROADCAST_ROWS
    small = lambda groups: F.broadcast(groups) if few else groups  # noqa: E731  one row a group, counted just now

    spread = (rows.join(small(center), KEY).groupBy(*KEY)
              .agg(*[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000),
                                F.lit(s.floors[i])).alias(f"s{i}") for i, x in enumerate(X)]))
    scaled = rows.join(small(center.join(small(spread), KEY).checkpoint()), KEY)
    z = [F.abs(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(X)]
    first = scaled.select(*KEY, *X, F.explode(F.array(
        F.struct(F.lit(0).alias("start"), sum((c * c for c in z), F.lit(0.0)).alias("d2")),
        F.struct(F.lit(1).alias("start"), F.greatest(*z).alias("d2")))).alias("d")).select(*KEY, *X, "d.*")

    keys = [*KEY, "start"]

    def concentrate_input(estimates: DataFrame) -> DataFrame:
        return rows.join(small(estimates.drop("logdet", "n", "cov")), KEY).select(*keys, *X, distance().alias("d2"))

    def concentrate(measured: DataFrame) -> DataFrame:
        cut = measured.groupBy(*keys).agg(F.percentile_approx("d2", s.support, 1000).alias("cut"))
        inside = measured.join(small(cut), keys).where(F.col("d2") <= F.col("cut"))
        return _estimates(_moments(inside, keys), keys, s.floors).checkpoint()

    now = concentrate(concentrate_input(concentrate(first)))
    best = (now.groupBy(*KEY).agg(F.min_by(F.struct("start", "n", "mean", "cov", "precision", "logdet"),
                                           F.struct("logdet", "start")).alias("e")).select(*KEY, "e.*").checkpoint())
    while True:
        then, best = best, concentrate(concentrate_input(best))
        moved = (best.select(*keys, F.col("logdet").alias("b"))
                 .join(small(then.select(*keys, F.col("logdet").alias("a"))), keys)
                 .agg(F.max(F.col("a") - F.col("b"))).first()[0])  # one number
        if moved is None or moved <= s.tolerance:
            break
    best = best.select(*KEY, "mean", "precision")

    # scale to a normal sample's median distance, then reweight once
    measured = rows.join(small(best), KEY).select(*KEY, *X, distance().alias("d2"))
    scale = measured.groupBy(*KEY).agg(F.greatest(F.percentile_approx("d2", 0.5, 2000) / CHI2_HALF, F.lit(1.0)).alias("scale"))
    good = measured.join(small(scale), KEY).where(F.col("d2") <= CHI2_975 * F.col("scale"))
    own = _estimates(_moments(good, KEY), KEY, s.floors).checkpoint()
    drawn = _drawn(own, s.prior, small)
    passed = rows.where((F.col(X[0]) > math.log1p(min_words) - 1e-9)
                        & (F.col(X[4]) < math.asin(math.sqrt(min(max_repeat_pct, 100) / 100)) + 1e-9))
    measured = passed.join(small(drawn), KEY).select(F.log(F.greatest(distance(), F.lit(1e-9))).alias("x"))
    return drawn.withColumn("cutoff", F.lit(_cutoff(measured, s)))


def _cutoff(measured: DataFrame, s: Settings) -> float:
    """The squared distance at ``outlier_z``, from the logarithms ``x`` of all."""
    median = measured.agg(F.percentile_approx("x", 0.5, 10_000)).first()[0]  # one number
    if median is None:
        return CHI2_975
    mad = measured.agg(F.percentile_approx(F.abs(F.col("x") - median), 0.5, 10_000)).first()[0]  # one number
    return max(CHI2_975, float(np.exp(min(median + s.outlier_z * mad / 0.6745, 700.0))))


# The chi-square distribution's median and 0.975 quantile at 7 degrees of freedom.
CHI2_HALF = 6.345811
CHI2_975 = 16.012764


def _drawn(own: DataFrame, prior: float, small) -> DataFrame:
    """Each estimate mixed with the wider group's by their numbers of vectors."""
    base = own.select(*KEY, "n", "mean", "cov")
    whole = base.where((F.col("g_lang") == ALL) & (F.col("g_source") == ALL)).first()  # one row
    lang = base.where((F.col("g_lang") != ALL) & (F.col("g_source") == ALL)).select(
        "g_lang", F.col("n").alias("l_n"), F.col("mean").alias("l_mean"), F.col("cov").alias("l_cov"))
    groups = base.where(F.col("g_source") != ALL).join(small(lang), "g_lang")

    def run(batches):
        for pdf in batches:
            mean, prec = [], []
            for r in pdf.itertuples():
                m, c = np.asarray(whole["mean"]), np.asarray(whole["cov"])
                for n, mm, cc in ((r.l_n, r.l_mean, r.l_cov), (r.n, r.mean, r.cov)):
                    share = n / (n + prior)
                    m, c = share * np.asarray(mm) + (1 - share) * m, share * np.asarray(cc) + (1 - share) * c
                full = np.zeros((D, D))
                for (i, j), v in zip(PAIRS, c):
                    full[i, j] = full[j, i] = v
                mean.append(m)
                prec.append([q[i, j] for q in [np.linalg.inv(full)] for i, j in PAIRS])
            yield pd.DataFrame({"g_lang": pdf["g_lang"], "g_source": pdf["g_source"], "mean": mean, "precision": prec})
    return groups.mapInPandas(run, "g_lang string, g_source string, mean array<double>, precision array<double>").checkpoint()


def with_verdict(stats: DataFrame, estimates: DataFrame, s: Settings, min_words: int, max_repeat_pct: int) -> DataFrame:
    """``stats`` (lang, source, STATS, anything else) with base_failed, distance2 and kept."""
    if estimates.count() <= BROADCAST_ROWS:
        estimates = F.broadcast(estimates)
    names = dict(zip(X, vector_columns())) | {"g_lang": F.coalesce("lang", F.lit("")), "g_source": F.coalesce("source", F.lit(""))}
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return (stats.withColumns(names).join(estimates, KEY, "left")
            .withColumn("base_failed", failed).withColumn("distance2", distance())
            .withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= F.col("cutoff")))
            .drop(*names, "mean", "precision", "cutoff"))


def judge(documents: DataFrame, s: Settings = Settings(), min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """doc_id, lang, source, STATS, base_failed, distance2 and kept for every row of ``documents``."""
    prepare(documents.sparkSession)
    stats = document_stats(documents).checkpoint()
    return with_verdict(stats, fit(stats, s, min_words, max_repeat_pct), s, min_words, max_repeat_pct)


def keep(documents: DataFrame, s: Settings = Settings(), min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """The rows of ``documents``, all columns, that the rules keep. Texts are not shuffled: their
    counts are taken twice, once for the estimates and once next to the row."""
    prepare(documents.sparkSession)
    estimates = fit(document_stats(documents).checkpoint(), s, min_words, max_repeat_pct)
    def make():
        def run(texts: list[str]) -> list[pa.Array]:
            return [pa.array(c, pa.int64()) for c in zip(*[text_stats(t) for t in texts])] or [pa.array([], pa.int64())] * len(STATS)
        return run
    counted = map_rows(documents, make, [StructField(c, LongType()) for c in STATS]).select(
        "*", F.col("row.lang").cast("string").alias("lang"), F.col("row.source").cast("string").alias("source"))
    judged = with_verdict(counted, estimates, s, min_words, max_repeat_pct)
    return judged.where("kept").select("row.*")
