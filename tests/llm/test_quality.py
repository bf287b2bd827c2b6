"""Quality rules and the quality classifier."""

import random
import re
from collections import Counter

import numpy as np
from helpers import empty, odd, odd_rows
from pyspark.sql import functions as F

from agora.llm import quality_classifier, quality_rules, queries
from agora.llm.common import crc_mod

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text):
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_text_stats():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choices(["a ", "b ", "c", "\n", " ", "é", "#", "a b c ", "\x0b", "\xa0", "<x> "], k=rng.randrange(60)))
        assert quality_rules.text_stats(text)[:5] == slow_stats(text), repr(text)


def slow_mcd(x, s):
    """The same estimate with numpy on one group."""
    d, floor = x.shape[1], np.square(s.floors)

    def estimate(rows):
        m, c = rows.mean(0), np.cov(rows.T, bias=True)
        c = c + np.diag(np.maximum(floor - np.diag(c), 0) + 0.01 * floor)
        return m, c

    def dist(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    med = np.median(x, 0)
    z = np.abs(x - med) / np.maximum(1.4826 * np.median(np.abs(x - med), 0), s.floors)
    best = None
    for d2 in ((z * z).sum(1), z.max(1)):
        for _ in range(100):
            m, c = estimate(x[d2 <= np.quantile(d2, s.support)])
            d2 = dist(m, c)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], d2)
    d2 = best[1]
    scale = max(np.median(d2) / quality_rules.CHI2_HALF, 1)
    return estimate(x[d2 <= quality_rules.CHI2_975 * scale])


def test_estimate_is_the_mcds(spark):
    """One language and source: the estimate agrees with a plain numpy one, planted outliers notwithstanding."""
    s = quality_rules.Settings(prior=0.0)
    stats = (quality_rules.document_stats(queries.table(spark, SF, "documents").where("lang = 'en'"))
             .withColumn("source", F.lit("one")))
    est = quality_rules.fit(stats, s).first()
    x = np.array([list(r) for r in stats.select(*[v.alias(c) for v, c in zip(
        quality_rules.vector_columns(), quality_rules.X)]).distinct().collect()])
    m, c = slow_mcd(x, s)
    got = np.zeros((quality_rules.D,) * 2)
    for (i, j), v in zip(quality_rules.PAIRS, est["precision"]):
        got[i, j] = got[j, i] = v
    scale = np.sqrt(np.diag(c))
    assert np.abs((np.array(est["mean"]) - m) / scale).max() < 0.05
    assert np.abs(np.linalg.inv(got) / np.outer(scale, scale) - c / np.outer(scale, scale)).max() < 0.1


def test_rules_keep_clean_and_reject_junk(spark):
    rows = queries.op2_quality_rules(spark, SF)
    labels = queries.table(spark, SF, "labels")
    got = rows.where("not base_failed").join(labels, "doc_id").collect()
    clean, junk = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert all(r.kept for r in clean)
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    for r in rows.collect():
        want = slow_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_copies_do_not_move_the_estimate(spark):
    """A third of all rows being copies of one odd text changes no verdict."""
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    copies = spark.range(100).select((F.col("id") + 10_000).alias("doc_id"), F.lit("### " * 300).alias("text"),
                                     F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    before = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    after = {r.doc_id: r.kept for r in quality_rules.judge(docs.unionByName(copies)).collect() if r.doc_id < 10_000}
    assert sum(before[i] != after[i] for i in before) <= 2


def test_rules_on_odd_rows(spark):
    out = quality_rules.judge(odd(spark)).collect()
    assert len(out) == len(odd_rows())
    assert all(r.kept is not None and r.base_failed is not None for r in out)
    kept = quality_rules.keep(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.kept)
    assert quality_rules.judge(empty(spark)).count() == 0 and quality_rules.keep(empty(spark)).count() == 0


def auc(labels, scores):
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(labels)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_classifier_on_held_out_labels(spark):
    out = queries.op3_quality_classifier(spark, SF)
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    assert out.count() == docs.count()
    got = out.where("held_out").join(labels, "doc_id").collect()
    assert auc([r.quality for r in got], [r.score for r in got]) > 0.98
    assert all(r.predicted == 1 for r in got if r.quality == 1)


def test_classifier_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.001", "documents"), queries.table(spark, "/root/testdata/sf0.001", "labels")
    admitted = crc_mod(F.col("doc_id"), 5) != 0
    one = quality_classifier.fit(docs, labels, admitted)
    flipped = labels.withColumn("quality", F.when(admitted, F.col("quality")).otherwise(1 - F.col("quality")))
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    two = quality_classifier.fit(other, flipped, admitted)
    assert np.array_equal(one, two)


def test_sparse_scoring_is_the_dense_product():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << 10) + 1)
    import pyarrow as pa
    texts = [t or "" for _, t, *_ in odd_rows()]
    for text, score in zip(texts, quality_classifier.scores(texts, w, 10)):
        dense = np.zeros(len(w))
        columns, values = quality_classifier.features(text, 10)
        dense[columns] = values
        assert abs(score - 1 / (1 + np.exp(-dense @ w))) < 1e-9


def test_classifier_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (14, 0), (8, 1), (99, 1)], "doc_id long, quality int")
    weights = quality_classifier.fit(odd(spark), labels, F.lit(True))
    out = quality_classifier.score(odd(spark), weights).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 for r in out)
    kept = quality_classifier.keep(odd(spark), weights, 0.3)
    assert kept.columns == odd(spark).columns and kept.count() == sum(r.score >= 0.3 for r in out)
    none = quality_classifier.fit(empty(spark), labels.where("false"), F.lit(True))
    assert all(r.score == 0.5 for r in quality_classifier.score(odd(spark), none).collect())
    assert quality_classifier.score(empty(spark), none).count() == 0
