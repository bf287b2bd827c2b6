"""Chunks of numbered words against plain counting, whatever the sizes of chunks, shards and buckets."""

import random
from collections import Counter

from agora.operators import polarity, wordtexts

WORDS = "a b c d e f gut größe été 東京 x1 _y".split()


def texts_of(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(n)] + [None, "", " .. ", "b", "a b a", "Été, ÉTÉ!"]


def small(monkeypatch, chunk, shard, bucket):
    for name, size in (("CHUNK", chunk), ("SHARD", shard), ("BUCKET", bucket)):
        monkeypatch.setattr(wordtexts, name, size)


def slow_pairs(texts, window):
    pairs = Counter()
    for text in texts:
        w = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()
        for i, x in enumerate(w):
            pairs.update(tuple(sorted((x, y))) for y in w[i + 1:i + 1 + window] if x != y)
    return pairs


def test_pairs_add_up_over_chunks(spark, monkeypatch):
    texts = texts_of(random.Random(2), 80)
    frame = spark.createDataFrame(list(enumerate(texts)), "comment_id long, body string").repartition(3)
    for sizes in ((1 << 21, 1 << 19, 1 << 21), (40, 2, 30)):
        small(monkeypatch, *sizes)
        for window, least in ((1, 1), (3, 2)):
            got = {(r["a"], r["b"]): r["n"] for r in polarity.cooccurrences(frame, window, least).collect()}
            assert got == {p: n for p, n in slow_pairs(texts, window).items() if n >= least}


def test_comments_are_scored_one_by_one_without_a_row_per_word(spark, monkeypatch):
    """Every comment by its own text, also where ids are null or equal (before: one sum per id); no word is exploded."""
    small(monkeypatch, 10, 1, 10)
    rows = [(1, "good good bad"), (1, "bad"), (None, "good"), (2, None), (3, "  "), (4, "unseen"), (5, "good weak weak bad")]
    rows += [(i, "unseen " * (i % 4) + "good") for i in range(10, 30)]
    frame = spark.createDataFrame(rows, "comment_id long, body string")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -1.0), ("weak", 0.04)], "word string, score double")
    scored = polarity.score(frame, lexicon)
    got = Counter((r["comment_id"], r["sentiment"]) for r in scored.collect())
    want = Counter({(1, "NEUTRAL"): 1, (1, "NEGATIVE"): 1, (None, "POSITIVE"): 1, (2, "NEUTRAL"): 1, (3, "NEUTRAL"): 1,
                    (4, "NEUTRAL"): 1, (5, "NEUTRAL"): 1})
    assert got == want + Counter((i, "POSITIVE") for i in range(10, 30))
    assert "Generate" not in scored._jdf.queryExecution().optimizedPlan().toString()
