import tempfile

from pyspark.sql import functions as F

from agora.operators import rollup
from agora.streaming import streams as S


def test_caps_count_across_micro_batches(spark):
    d = tempfile.mkdtemp(prefix="agora-stream-test-")
    a = spark.createDataFrame([(1, t, "u") for t in range(3)] + [(2, 0, "u")],
                              "conv_id long, turn long, role string")
    b = spark.createDataFrame([(1, t, "u") for t in range(3, 6)] + [(2, 1, "u")],
                              "conv_id long, turn long, role string")
    a.coalesce(1).write.parquet(f"{d}/in/part-a")
    b.coalesce(1).write.parquet(f"{d}/in/part-b")
    stream = (spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(f"{d}/in"))
    out = S.run_capped(stream, "test-caps", "conv_id", ["turn"], cap=4).collect()
    per = {}
    for r in out:
        per.setdefault(r.conv_id, []).append(r.turn)
    assert len(per[1]) == 4 and len(per[2]) == 2


def test_partials_combine_to_weighted_mean(spark):
    rows = [(1, 1704067200, "SUPPORT", 0.2), (1, 1704067200, "SUPPORT", None),
            (1, 1704067200, "OPPOSE", 0.8)]
    df = spark.createDataFrame(rows, "topic_id long, created_utc long, stance string, toxicity double")
    partial = df.groupBy("topic_id", "stance").agg(
        F.count("*").alias("cnt"), F.sum(rollup.units(F.col("toxicity"))).alias("tox_units"),
        F.count("toxicity").alias("tox_n"))
    partial = partial.withColumn("date", F.lit("2024-01-01").cast("date"))
    r = S.finish_daily(partial).first()
    assert abs(r.avg_toxicity - 0.4) < 1e-12 and r.total_comments == 3


def _events(spark, d, parts=4):
    """The events table as several files, their rows in shuffled order."""
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.orderBy(F.md5(F.col("event_id").cast("string"))).repartition(parts).write.parquet(f"{d}/events.parquet")
    return src


def test_streams_read_tables_of_many_files(spark, tmp_path):
    from agora.operators import rollup
    from agora.sources import tables as T
    src = _events(spark, tmp_path)
    stream = S.stream_table(spark, str(tmp_path), "events", max_files=1)
    work = str(tmp_path / "work")
    partials = S.run_update(S.daily_partials(T.classified_from_events(stream)), "t", ["topic_id", "date", "stance"], work)
    got = {(r.topic_id, r.date): (r.total_comments, round(r.avg_toxicity or 0, 9)) for r in S.finish_daily(partials).collect()}
    batch = rollup.daily_stats(T.classified_from_events(src)).collect()
    assert got == {(r.topic_id, r.date): (r.total_comments, round(r.avg_toxicity or 0, 9)) for r in batch}


def test_stream_resumes_from_its_folder(spark, tmp_path):
    _events(spark, tmp_path, 2)
    stream = lambda: S.stream_table(spark, str(tmp_path), "events").select("event_id")
    work = str(tmp_path / "work")
    first = S.run_append(stream(), "t", work).count()
    assert S.run_append(stream(), "t", work).count() == first  # nothing is read twice
    spark.read.parquet(f"{tmp_path}/events.parquet").limit(5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert S.run_append(stream(), "t", work).count() == first + 5


def test_missing_table_is_an_error(spark, tmp_path):
    import pytest
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.stream_table(spark, str(tmp_path), "events")


LATE_SCHEMA = "topic_id long, comment_id long, created_utc long, stance string, toxicity double"


def test_late_rows_go_to_the_side_and_their_days_are_repaired(spark, tmp_path):
    from agora.operators import rollup
    day, base = 86400, 1704067200
    row = lambda i, d, s, t: (i % 2, i, base + d * day + i, s, t)
    arrivals = [
        [row(1, 0, "SUPPORT", 0.2), row(2, 0, "OPPOSE", None), row(3, 1, "MIXED", 0.4)],
        [row(4, 5, "NEUTRAL", 0.5), row(5, 0, "SUPPORT", 0.9)],    # not late yet: nothing newer came before
        [row(6, 0, "SUPPORT", 0.7), row(7, 4, "OPPOSE", 0.1), row(8, 3, "MIXED", 0.3)],  # two days are closed
        [row(9, 1, "OPPOSE", 0.6)],
    ]
    everything = spark.createDataFrame([r for a in arrivals for r in a], LATE_SCHEMA)
    for rows in arrivals:
        spark.createDataFrame(rows, LATE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(LATE_SCHEMA).parquet(f"{tmp_path}/in")
        partials, late = S.run_daily_with_late_rows(stream, "t", day, str(tmp_path / "work"))
    assert sorted(r.comment_id for r in late.collect()) == [6, 8, 9]
    want = {tuple(r) for r in rollup.daily_stats(everything).collect()}
    assert {tuple(r) for r in S.finish_daily(partials).collect()} != want
    repaired = S.repair_days(partials, late, everything)
    assert {tuple(r) for r in S.finish_daily(repaired).collect()} == want
    touched = {(r.topic_id, str(r.date)) for r in late.select("topic_id", rollup.comment_date(F.col("created_utc")).alias("date")).collect()}
    kept = {tuple(r) for r in partials.collect() if (r.topic_id, str(r.date)) not in touched}
    assert kept <= {tuple(r) for r in repaired.collect()}


def test_toxicity_sums_do_not_depend_on_the_order_of_rows(spark):
    from agora.operators import rollup
    rows = [(1, 1704067200, "SUPPORT" if i % 3 else "OPPOSE", (i * 7919 % 50000) / 50000) for i in range(999)]
    schema = "topic_id long, created_utc long, stance string, toxicity double"
    a = rollup.daily_stats(spark.createDataFrame(rows, schema).repartition(7)).collect()
    b = rollup.daily_stats(spark.createDataFrame(rows[::-1], schema).coalesce(1)).collect()
    assert a == b
