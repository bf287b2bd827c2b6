from agora.operators import cluster as CL
from agora.operators import reports

CSCHEMA = "comment_id long, topic_id long, body string, author_hash string, created_utc long, score int"


def _comments(spark, n=5, topic=1):
    return spark.createDataFrame([(i, topic, f"body {i}", None, 1700000000 + i, 5) for i in range(n)],
                                 CSCHEMA)


def _cls(spark, rows):
    return spark.createDataFrame(rows, "comment_id long, stance string, sentiment string, toxicity double")


def test_unclassified_defaults(spark):
    page = reports.comments_page(_comments(spark, 1), _cls(spark, []), 1).first()
    assert (page.stance, page.sentiment, page.toxicity_score) == ("NEUTRAL", "NEUTRAL", 0.0)


def test_pagination_total_before_limit(spark):
    rows = reports.comments_page(_comments(spark, 5), _cls(spark, []), 1, limit=2).collect()
    assert len(rows) == 2 and rows[0].total == 5
    assert rows[0].created_utc > rows[1].created_utc


def test_filter_drops_unclassified(spark):
    cls = _cls(spark, [(0, "NEUTRAL", "NEUTRAL", 0.1)])
    rows = reports.comments_page(_comments(spark, 3), cls, 1, stance="NEUTRAL").collect()
    assert [r.comment_id for r in rows] == [0]


def test_toxicity_range_inclusive(spark):
    cls = _cls(spark, [(0, "SUPPORT", "NEUTRAL", 0.2), (1, "SUPPORT", "NEUTRAL", 0.5),
                       (2, "SUPPORT", "NEUTRAL", 0.8)])
    rows = reports.comments_page(_comments(spark, 3), cls, 1, toxicity_min=0.2, toxicity_max=0.5).collect()
    assert sorted(r.comment_id for r in rows) == [0, 1]


def test_stance_breakdown_zero_filled(spark):
    c = _comments(spark, 3)
    cls = _cls(spark, [(0, "SUPPORT", "NEUTRAL", 0.0), (1, "SUPPORT", "NEUTRAL", 0.0),
                       (2, "ODD", "NEUTRAL", 0.0)])
    got = {r.stance: r.n for r in reports.stance_breakdown(c, cls).collect()}
    assert got == {"SUPPORT": 2, "OPPOSE": 0, "MIXED": 0, "NEUTRAL": 0, "ODD": 1}


def test_classified_gate(spark):
    c = _comments(spark, 3)
    none = reports.classified_gate(c, _cls(spark, []), minimum=2).first()
    assert (none.clustering_available, none.reason, none.classified_comments) == (False, "insufficient_data", 0)
    cls = _cls(spark, [(i, "SUPPORT", "NEUTRAL", 0.0) for i in range(3)])
    ok = reports.classified_gate(c, cls, minimum=3).first()
    assert ok.clustering_available is True and ok.reason is None


def test_coverage(spark):
    r = reports.classification_coverage(_comments(spark, 4),
                                        _cls(spark, [(0, "SUPPORT", "NEUTRAL", 0.0)])).first()
    assert (r.total_comments, r.classified, r.pending, r.coverage_pct) == (4, 1, 3, 25.0)


def _members(spark, rows):
    return spark.createDataFrame(rows, "cluster long, comment_id long, body string, score int")


def test_quotes_limit_three(spark):
    rows = [(1, i, f"{i:03d}" + "x" * 60, i) for i in range(6)]
    q = CL.top_quotes(_members(spark, rows), ["cluster"]).collect()
    assert len(q) == 3


def test_quotes_length_and_dedupe_and_order(spark):
    long = "y" * 60
    rows = [(1, 1, "z" * 39, 100), (1, 2, long, 1), (1, 3, long, 99), (1, 4, long, 50), (1, 5, long, 2),
            (1, 6, "w" * 45, 50)]
    q = CL.top_quotes(_members(spark, rows), ["cluster"]).orderBy("quote_rank").collect()
    assert [r.comment_id for r in q] == [3, 6]   # 39-char body skipped, identical bodies once
    assert [r.score for r in q] == sorted([r.score for r in q], reverse=True)
