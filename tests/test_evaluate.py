from agora.operators import evaluate as V


def test_report_matches_hand_computation(spark):
    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "B"), ("C", "A")],
                                  "y_true string, y_pred string")
    rep = {(r.kind, r.label): r for r in V.classification_report(pairs, "t").collect()}
    a = rep[("class", "A")]
    assert (a.precision, a.recall) == (0.5, 0.5)
    c = rep[("class", "C")]
    assert (c.precision, c.recall, c.f1) == (0.0, 0.0, 0.0)
    assert rep[("accuracy", "accuracy")].precision == 0.6
    assert rep[("micro", "micro")].precision == 0.6
    assert rep[("macro", "macro")].recall == round((0.5 + 1.0 + 0.0) / 3, 4)


def test_mae(spark):
    pairs = spark.createDataFrame([(3, 1.0), (0, 0.5)], "label int, score double")
    assert V.toxicity_mae(pairs).first().mae == 0.25


def test_labelled_counts(spark):
    df = spark.createDataFrame([("SUPPORT", "", " "), ("", "POSITIVE", "2")],
                               "stance string, sentiment string, toxicity string")
    r = V.labelled_counts(df).first()
    assert (r.stance, r.sentiment, r.toxicity) == (1, 1, 1)
