"""TF-IDF keywords from packed postings, against dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from agora import lexicon
from agora.operators import keywords as K

STOP = set(lexicon.english_stop_words())


def plain(rows, n, max_features):
    texts, sizes = defaultdict(Counter), Counter()
    for g, d, t in rows:
        if g is None:
            continue
        sizes[g] += 1
        uni = [w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in STOP]
        texts[g, d].update(uni + [f"{a} {b}" for a, b in zip(uni, uni[1:])])
    out = []
    for g in sizes:
        docs = {d: c for (h, d), c in texts.items() if h == g}
        df = Counter(t for c in docs.values() for t in c)
        cf = sum(docs.values(), Counter())
        known = set(sorted(cf, key=lambda t: (-cf[t], t))[:max_features])
        score = Counter()
        for c in docs.values():
            w = {t: k * (math.log((1 + sizes[g]) / (1 + df[t])) + 1) for t, k in c.items() if t in known}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for t, x in w.items():
                score[t] += x / norm / sizes[g]
        rounded = {t: round(s, 9) for t, s in score.items() if not set(t.split()) & set(lexicon.KEYWORD_EXTRA_STOP)}
        terms = sorted(sorted(rounded, reverse=True), key=lambda t: -rounded[t])[:n]
        out += [(g, i + 1, t, rounded[t]) for i, t in enumerate(terms)]
    return sorted(out)


def rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "the", "like", "x", "straße", "naïve", "d_1", "42"] + [f"w{i}" for i in range(40)]
    out = [(g, i, " ".join(rng.choices(words, weights=range(50, 0, -1), k=rng.randint(0, 60))))
           for g in ("a", "b") for i in range(40)]
    return out + [("a", 3, "alpha beta again, the same id"), ("b", None, "no id here"), ("b", None, "nor here"), ("b", 99, None),
                  (None, 5, "no group"), ("c", 1, "the a of"), ("d", 1, "lonely words lonely"), ("d", 2, "like like")]


@pytest.mark.parametrize("block", [100, 1 << 24])
@pytest.mark.parametrize("features", [None, 30, 5])
def test_scores_are_the_plain_ones(spark, monkeypatch, block, features):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    df = spark.createDataFrame(rows(), "g string, doc_id long, text string").repartition(3)
    got = [tuple(r)[:4] for r in K.tfidf_keywords(df, "g", 8, features).collect()]
    want = plain(rows(), 8, features)
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(sorted(got), want))


def test_a_document_sends_one_row_to_a_bucket(spark, monkeypatch):
    """Not one row per term: what is shuffled grows with the text, and a bucket is bounded however large the group."""
    monkeypatch.setattr(K, "BLOCK_BYTES", 1000)
    text = " ".join(f"word{i}" for i in range(200))
    df = spark.createDataFrame([(1, i, text) for i in range(3)], "g long, doc_id long, text string")
    out = K.postings(df, "g").collect()
    buckets = math.ceil(3 * len(text) / 1000)
    assert 3 < len(out) <= 3 * buckets and all(0 <= r.bucket < buckets for r in out)
    assert len({(r.doc_id, r.bucket) for r in out}) == len(out)
    assert sum(len(r.terms.split("\n")) for r in out) == 3 * (200 + 199)
    where = {}
    assert all(where.setdefault(t, r.bucket) == r.bucket for r in out for t in r.terms.split("\n"))


def test_cluster_keywords_do_not_hang_on_the_bucket_size(spark, monkeypatch):
    """The clustering job takes every term of a cluster, in buckets however large the cluster is."""
    from agora.operators import cluster as CL
    rng = random.Random(2)
    comments = spark.createDataFrame(
        [(i, 1, " ".join(rng.choices(["rust", "python", "java", "compiler", "types"], k=30)), i) for i in range(40)],
        "comment_id long, topic_id long, body string, score int")
    classes = comments.selectExpr("comment_id", "'SUPPORT' as stance")
    vectors = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2, i / 1000]) for i in range(40)],
                                    "comment_id long, embedding array<double>")
    seen, calls = [], []
    split = K.postings
    monkeypatch.setattr(K, "postings", lambda *a, **b: calls.append(split(*a, **b)) or calls[-1])
    for block in (1 << 24, 500):
        monkeypatch.setattr(K, "BLOCK_BYTES", block)
        out = CL.cluster_job(comments, classes, vectors, k=2)["clusters"]
        seen.append(sorted((r["cluster"], r["keywords"]) for r in out.collect()))
    assert len(seen[0]) == 2 and all(k for _, k in seen[0]) and seen[0] == seen[1]
    assert calls[0].agg({"bucket": "max"}).first()[0] == 0 and calls[1].agg({"bucket": "max"}).first()[0] > 3
