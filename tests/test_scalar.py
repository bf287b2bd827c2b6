from pyspark.sql import functions as F

from agora.functions import scalar as S


def test_sentiment_threshold(spark):
    rows = [("POSITIVE", 0.85), ("NEGATIVE", 0.8499), ("WEIRD", 0.99), ("LABEL_0", 0.99)]
    df = spark.createDataFrame(rows, "label string, score double")
    out = [r[0] for r in df.select(S.sentiment_from_output(F.col("label"), F.col("score"))).collect()]
    assert out == ["POSITIVE", "NEUTRAL", "NEUTRAL", "NEGATIVE"]


def test_toxicity_contract(spark):
    rows = [("LABEL_1", 0.9), ("LABEL_0", 0.8), ("LABEL_1", 1.1), ("LABEL_1", -0.1), ("", 0.6)]
    df = spark.createDataFrame(rows, "label string, score double")
    out = [round(r[0], 6) for r in df.select(S.toxicity_from_output(F.col("label"), F.col("score"))).collect()]
    assert out == [0.9, 0.2, 1.0, 0.0, 0.4]


def test_tier(spark):
    df = spark.createDataFrame([(0.29,), (0.3,), (0.69,), (0.7,)], "s double")
    assert [r[0] for r in df.select(S.toxicity_tier(F.col("s"))).collect()] == \
        ["low", "medium", "medium", "high"]


def test_hypotheses(spark):
    df = spark.createDataFrame([(["Claude", "OpenAI"],), ([],)], "t array<string>")
    out = [r[0] for r in df.select(S.hypothesis_labels(F.col("t"))).collect()]
    assert len(out[0]) == 4 and all("Claude" in h for h in out[0])
    assert not any("OpenAI" in h for h in out[0])
    assert out[1][0] == "This comment supports the main subject."


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(S.safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.25]


def test_stance_from_index(spark):
    df = spark.createDataFrame([(0,), (3,), (9,)], "i int")
    assert [r[0] for r in df.select(S.stance_from_index(F.col("i"))).collect()] == \
        ["SUPPORT", "NEUTRAL", "NEUTRAL"]
