import datetime as dt

from agora.operators import reports, rollup

BASE = 1704067200  # 2024-01-01 UTC

SCHEMA = "comment_id long, topic_id long, created_utc long, stance string, toxicity double"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_same_day(spark):
    d = rollup.daily_stats(_df(spark, [(1, 1, BASE, "SUPPORT", None), (2, 1, BASE + 5, "SUPPORT", None),
                                       (3, 1, BASE + 9, "OPPOSE", None)])).first()
    assert (d.stance_support_count, d.stance_oppose_count, d.stance_mixed_count,
            d.stance_neutral_count, d.total_comments) == (2, 1, 0, 0, 3)


def test_toxicity_average_across_stances(spark):
    d = rollup.daily_stats(_df(spark, [(1, 1, BASE, "SUPPORT", 0.2), (2, 1, BASE, "OPPOSE", 0.4)])).first()
    assert abs(d.avg_toxicity - 0.3) < 1e-12


def test_only_null_toxicity(spark):
    d = rollup.daily_stats(_df(spark, [(1, 1, BASE, "SUPPORT", None)])).first()
    assert d.avg_toxicity is None


def test_weighted_by_full_group_count(spark):
    # a:{0.2, null}, b:{0.8} -> (0.2*2 + 0.8*1) / 3 = 0.4, not the plain mean 0.5
    d = rollup.daily_stats(_df(spark, [(1, 1, BASE, "SUPPORT", 0.2), (2, 1, BASE, "SUPPORT", None),
                                       (3, 1, BASE, "OPPOSE", 0.8)])).first()
    assert abs(d.avg_toxicity - 0.4) < 1e-12


def test_unknown_stance_counts_in_total_only(spark):
    d = rollup.daily_stats(_df(spark, [(1, 1, BASE, "OTHER", None), (2, 1, BASE, "SUPPORT", None)])).first()
    assert d.total_comments == 2 and d.stance_support_count == 1


def test_two_dates_and_rerun_upsert(spark):
    rows = [(1, 1, BASE, "SUPPORT", None), (2, 1, BASE + 86400, "SUPPORT", None)]
    first = rollup.daily_stats(_df(spark, rows))
    assert first.count() == 2
    rerun = rollup.daily_stats(_df(spark, rows + [(3, 1, BASE, "OPPOSE", None)]))
    merged = rollup.upsert_daily_stats(first, rerun.where("date = date'2024-01-01'"))
    got = {r.date: r.total_comments for r in merged.collect()}
    assert got == {dt.date(2024, 1, 1): 2, dt.date(2024, 1, 2): 1}


def test_upsert_keeps_other_topics(spark):
    a = rollup.daily_stats(_df(spark, [(1, 1, BASE, "SUPPORT", None), (2, 2, BASE, "SUPPORT", None)]))
    b = rollup.daily_stats(_df(spark, [(1, 1, BASE, "OPPOSE", None)]))
    merged = {(r.topic_id, r.stance_oppose_count) for r in rollup.upsert_daily_stats(a, b).collect()}
    assert merged == {(1, 1), (2, 0)}


def test_active_topics_only(spark):
    d = rollup.daily_stats(_df(spark, [(1, t, BASE, "SUPPORT", None) for t in (1, 2, 3)]))
    topics = spark.createDataFrame([(1, "active"), (2, "active"), (3, "archived")],
                                   "topic_id long, status string")
    assert rollup.active_topics_only(d, topics).count() == 2


def test_timeline_order_range_and_pct(spark):
    rows = [(i, 1, BASE + 86400 * day, s, None)
            for i, (day, s) in enumerate([(9, "SUPPORT"), (0, "OPPOSE"), (3, "SUPPORT"),
                                          (1, "MIXED"), (5, "NEUTRAL")])]
    daily = rollup.daily_stats(_df(spark, rows))
    t = reports.timeline(daily, 1).collect()
    assert [r.date for r in t] == sorted(r.date for r in t)
    assert len(reports.timeline(daily, 1, date_from="2024-01-04").collect()) == 3
    assert len(reports.timeline(daily, 1, date_to="2024-01-02").collect()) == 2
    r = t[0]
    assert abs(r.support_pct + r.oppose_pct + r.mixed_pct + r.neutral_pct - 1.0) < 1e-12


def test_timeline_pct_sums_to_one(spark):
    rows = ([(i, 1, BASE, "SUPPORT", None) for i in range(5)] +
            [(10 + i, 1, BASE, "OPPOSE", None) for i in range(3)] +
            [(20, 1, BASE, "MIXED", None), (21, 1, BASE, "NEUTRAL", None)])
    r = reports.timeline(rollup.daily_stats(_df(spark, rows)), 1).first()
    assert abs(r.support_pct - 0.5) < 1e-12
    assert abs(r.support_pct + r.oppose_pct + r.mixed_pct + r.neutral_pct - 1) < 1e-12
