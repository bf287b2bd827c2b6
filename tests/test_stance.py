"""Stance depends on the target, not on the text alone."""

import random

import pytest

from agora.operators import classify, evaluate, stance
from pyspark.sql import functions as F

SCHEMA = "id long, body string, target_terms string, stance string"


def made(rng, n, start=0):
    """Two subjects in a text, one praised and one blamed; the target is either, or another named without a view."""
    good, bad = ["excellent", "useful", "helpful", "great"], ["terrible", "broken", "awful", "useless"]
    fill = "then today still there people said maybe often again".split()
    rows = []
    for i in range(start, start + n):
        a, b = rng.sample(["alpha", "beta", "gamma", "delta"], 2)
        f = lambda: " ".join(rng.choices(fill, k=5))
        first, second = (a, rng.choice(good)), (b, rng.choice(bad))
        if rng.random() < 0.5:
            first, second = second, first
        body = f"{f()} {first[0]} is {first[1]} {f()} {second[0]} is {second[1]} {f()}"
        target, label = rng.choice([(a, "SUPPORT"), (b, "OPPOSE"), ("omega", "NEUTRAL")])
        rows.append((i, body, target, label))
    return rows


def macro_f1(pairs):
    return evaluate.classification_report(pairs, "stance").where("kind = 'macro'").first()["f1"]


def test_target_decides(spark):
    rng = random.Random(11)
    train, held = made(rng, 400), made(rng, 150, 400)
    model = stance.fit(spark.createDataFrame(train, SCHEMA), window=3, rounds=25)
    test = spark.createDataFrame(held, SCHEMA).withColumnRenamed("stance", "truth")
    learned = macro_f1(model.predict(test).select(F.col("truth").alias("y_true"), F.col("stance").alias("y_pred")))
    listed = macro_f1(test.select(F.col("truth").alias("y_true"), classify.score_stance(F.col("body")).alias("y_pred")))
    print("held-out macro F1", learned, "word list", listed)
    assert learned > 0.9 > listed
    same = "people said alpha is excellent today then again still often maybe beta is awful today"
    both = spark.createDataFrame([(1, same, "alpha"), (2, same, "beta")], "id long, body string, target_terms string")
    assert dict(model.predict(both).select("id", "stance").collect()) == {1: "SUPPORT", 2: "OPPOSE"}


def test_features(spark):
    df = spark.createDataFrame([(1, "a b Big c d e f", "big"), (2, "a big b big", "big"), (3, "x", None), (4, None, "x"),
                                (5, "new york is", "New York, ,zed")], "id long, body string, target_terms string")
    got = {r["id"]: r["features"] for r in stance.features(df, window=2).collect()}
    assert got[1] == ["near a", "before a", "near b", "before b", "mention", "near c", "after c", "near d", "after d",
                      "far e", "far f"]
    assert got[2] == ["near a", "before a", "mention", "near b", "after b", "before b", "mention"]
    assert got[3] == ["far x"] and got[4] == []
    assert got[5] == ["mention", "mention", "near is", "after is"]


def test_blank_and_unknown_labels(spark):
    rows = [(1, "alpha good", "alpha", "SUPPORT"), (2, "alpha bad", "alpha", "OPPOSE"), (3, "alpha so", "alpha", "whatever"),
            (4, None, "alpha", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = stance.fit(df, rounds=5)
    blank = spark.createDataFrame([(1, " ", "alpha"), (2, None, None)], "id long, body string, target_terms string")
    assert {r["stance"] for r in model.predict(blank).collect()} == {"NEUTRAL"}
    with pytest.raises(ValueError):
        stance.fit(df.where("stance = 'whatever'"))


def test_features_are_the_plain_ones_and_each_side_is_looked_for_once(spark):
    import random
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["rust", "java", "a", "b", "c", "d", "e"], weights=[1, 1, 9, 9, 9, 9, 9], k=n)), "Rust, Java")
            for i, n in enumerate([0, 1, 2, 5, 6, 40, 200])] + [(90, None, "Rust"), (91, "rust on", None), (92, "no mention", "Go")]
    for window in (1, 5):
        out = stance.features(spark.createDataFrame(rows, "id long, body string, target_terms string"), window=window)
        for r in out.collect():
            words = (r.body or "").lower().split()
            hit = [w in (r.target_terms or "").lower().split(", ") for w in words]
            want = []
            for i, w in enumerate(words):
                after, before = any(hit[max(i - window, 0):i]), any(hit[i + 1:i + 1 + window])
                want += (["mention"] if hit[i] else [f"near {w}"] * (after or before) + [f"after {w}"] * after
                         + [f"before {w}"] * before or [f"far {w}"])
            assert r.features == want
        assert out._jdf.queryExecution().analyzed().toString().count("slice(") == 2
