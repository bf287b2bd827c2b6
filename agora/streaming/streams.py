"""Structured Streaming versions of the polled jobs (T1-T7; caps over cycles: caps.py).

The original service polls every N minutes and recomputes; here new item
files arrive in a directory and a streaming query processes them
incrementally (``trigger(availableNow=True)`` for catch-up runs,
``processingTime`` for a long-running job). Sinks are idempotent: append-only
Parquet, or one folder per micro-batch that a retry overwrites. Checkpoints
and outputs live in the ``work`` folder the caller names, from which a later
run resumes, or in one of the run's own under the session's shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from agora.functions.text import on_target, split_terms
from agora.operators import rollup
from agora.operators.common import last_per_key, with_target_terms
from agora.operators.ingest import ITEM_SCHEMA
from agora.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str,
                 max_files: int | None = None) -> DataFrame:
    """A driver table as a file stream.

    The table is a folder of files, whose new files are picked up as they
    arrive, or a single file. A table that is not there is an error, not an
    empty stream.
    """
    table = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(table).schema  # raises if there is nothing to read
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = spark.read.format("binaryFile").load(table).select("path")  # names only; contents are not read
    if files.where(~F.col("path").endswith(f"/{name}.parquet")).isEmpty():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(table)


def _workdir(spark: SparkSession, name: str, work: str | None = None) -> str:
    """Where a stream keeps its checkpoint and output. A caller that passes the same ``work`` again
    resumes the stream; without one, a run of its own starts under the shared folder."""
    if work:
        return work.rstrip("/")
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/agora-streams/{name}-{uuid.uuid4().hex}"


def run_append(stream: DataFrame, name: str, work: str | None = None) -> DataFrame:
    """Run an append-mode stream to completion into parquet; read it back."""
    spark = stream.sparkSession
    work = _workdir(spark, name, work)
    q = (stream.writeStream.format("parquet").option("path", f"{work}/out")
         .option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def run_update(stream: DataFrame, name: str, keys: list[str], work: str | None = None) -> DataFrame:
    """Run an update-mode aggregation; every micro-batch's changed rows go
    to their own batch folder (overwrite => idempotent on retry). The
    result is the newest version of every key (max_by over batch ids)."""
    spark = stream.sparkSession
    work = _workdir(spark, name, work)

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{work}/out/batch_id={batch_id}"))

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    others = [c for c in out.columns if c not in keys and c != "batch_id"]
    latest = out.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("r"))
    return latest.select(*keys, *[F.col("r." + c).alias(c) for c in others])


def daily_partials(classified: DataFrame, watermark: str | None = None) -> DataFrame:
    """Stage one of the daily rollup as a streaming aggregate.

    Per (topic, UTC day, stance): row count, toxicity sum and non-null
    count - sums that combine exactly into the two-stage weighted mean.
    Without a ``watermark`` no row is late and the state keeps every day. With
    one, rows of days that ended before it are dropped by the stream;
    ``run_daily_with_late_rows`` keeps them in a side table (T6).
    """
    rows = classified.withColumn("event_time", F.timestamp_seconds(F.col("created_utc")))
    if watermark is not None:
        rows = rows.withWatermark("event_time", watermark)
    return (rows.groupBy(F.window("event_time", "1 day").alias("w"), "topic_id", "stance")
            .agg(*rollup.partials())
            .select("topic_id", F.to_date(F.col("w.start")).alias("date"), "stance",
                    "cnt", "tox_units", "tox_n"))


def finish_daily(partials: DataFrame) -> DataFrame:
    """Stage two of the daily rollup over the streamed partials (batch)."""
    return finish_rollup(partials, ["topic_id", "date"])


def finish_rollup(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Stage two of a two-stage rollup over streamed partials, per ``keys``."""
    return rollup.combine(partials, keys)


BROKEN = "_broken"


def item_stream(spark: SparkSession, folder: str, archive: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Item dumps (JSON lines) that arrive in ``folder``, read with the declared schema.

    A line that is not JSON, or whose fields have other types, comes with its
    text in ``_broken``. With ``archive`` Spark moves a file there once a later
    batch has committed the one that read it.
    """
    reader = (spark.readStream.schema(StructType([*ITEM_SCHEMA.fields, StructField(BROKEN, StringType())]))
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(folder).withColumn("source_file", F.col("_metadata.file_path"))


def run_items(items: DataFrame, name: str, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run an ``item_stream`` over what has arrived: (items, broken lines).

    Both tables are one folder per batch, which a retry overwrites; ``batch_id``
    tells the order of arrival. Lines that can't be read and items without an
    id go to the side table (line, source_file, reason). Blank lines are no items.
    """
    spark = items.sparkSession
    work = _workdir(spark, name, work)
    reason = F.when(F.col(BROKEN).isNotNull(), "unreadable").when(F.col("id").isNull(), "no id")
    fields = [f.name for f in ITEM_SCHEMA.fields]

    def tables(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        return (batch.where(reason.isNull()).select(*fields, "source_file"),
                batch.where(reason.isNotNull()).select(
                    F.coalesce(BROKEN, F.to_json(F.struct(*fields))).alias("line"), "source_file", reason.alias("reason")))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for table, rows in zip(("items", "broken"), tables(batch)):
            rows.write.mode("overwrite").parquet(f"{work}/{table}/batch_id={batch_id}")
        batch.unpersist()

    write(spark.createDataFrame([], items.schema), -1)  # tables that exist before anything has arrived
    q = (items.writeStream.foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{work}/items"), spark.read.parquet(f"{work}/broken")


def latest_items(items: DataFrame) -> DataFrame:
    """The newest version of every item of ``run_items``: by batch; within one by time, score and text."""
    rows = items.select(*[f.name for f in ITEM_SCHEMA.fields], "batch_id")
    order = [F.col("batch_id"), F.col("time"), F.col("score"), F.to_json(F.struct(*rows.columns))]
    return last_per_key(rows, ["id"], order).drop("batch_id")


def dedup_stream(items: DataFrame, key: list[str], event_time: str,
                 delay: str = "1 hour") -> DataFrame:
    """Idempotent re-ingest - an item seen again within the watermark
    delay is dropped (state expires with the watermark)."""
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def gate_stream(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Stream-static join with the posts' target terms, then the gate."""
    j = with_target_terms(comments, posts)
    terms = split_terms(F.col("target_terms"))
    return j.select("comment_id", "post_id", F.size(terms).alias("n_terms"),
                    on_target(F.col("body"), terms).alias("on_target"))


def day_is_closed(created_utc, watermark: int):
    """Whether the day of a comment ended before the watermark (epoch seconds): a daily rollup drops such a row."""
    return (F.floor(created_utc / 86400) + 1) * 86400 <= F.lit(watermark)


def run_daily_with_late_rows(classified: DataFrame, name: str, delay_seconds: int,
                             work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """T3 and T6 in one query: the daily partials, and the rows that the watermark drops from them.

    The sink of every micro-batch gets both the changed partials and the
    batch's own rows (one source feeds both branches). The watermark in force
    is the newest time of all earlier batches less the delay; a row of a day that
    ended before it is late and goes to the side table. All three outputs are
    one folder per batch, which a retry overwrites.
    """
    spark = classified.sparkSession
    work = _workdir(spark, name, work)
    parts = daily_partials(classified, f"{delay_seconds} seconds").select(
        F.struct("topic_id", "date", "stance", "cnt", "tox_units", "tox_n").alias("part"),
        F.lit(None).cast(classified.select(F.struct("*").alias("r")).schema["r"].dataType).alias("row"))
    raw = classified.select(F.lit(None).cast(parts.schema["part"].dataType).alias("part"), F.struct("*").alias("row"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        rows = batch.where(F.col("row").isNotNull()).select("row.*")
        changed = batch.where(F.col("part").isNotNull()).select("part.*")
        changed.write.mode("overwrite").parquet(f"{work}/out/batch_id={batch_id}")
        rows.agg(F.max("created_utc").alias("newest")).write.mode("overwrite").parquet(f"{work}/seen/batch_id={batch_id}")
        newest = (spark.read.parquet(f"{work}/seen").where(F.col("batch_id") < batch_id)
                  .agg(F.max("newest")).first()[0])  # one number
        late = rows.where(F.lit(False) if newest is None else day_is_closed(F.col("created_utc"), newest - delay_seconds))
        late.write.mode("overwrite").parquet(f"{work}/late/batch_id={batch_id}")
        batch.unpersist()

    q = (parts.unionByName(raw).writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    keys = ["topic_id", "date", "stance"]
    latest = spark.read.parquet(f"{work}/out").groupBy(*keys).agg(
        F.max_by(F.struct("cnt", "tox_units", "tox_n"), "batch_id").alias("r"))
    return latest.select(*keys, "r.*"), spark.read.parquet(f"{work}/late").drop("batch_id")


def repair_days(partials: DataFrame, late: DataFrame, history: DataFrame) -> DataFrame:
    """The days that late rows touched, counted again from the stored comments; other days stay as streamed."""
    date = rollup.comment_date(F.col("created_utc")).alias("date")
    touched = late.select("topic_id", date).distinct()
    again = (history.select("topic_id", date, "stance", "toxicity").join(touched, ["topic_id", "date"], "left_semi")
             .groupBy("topic_id", "date", "stance").agg(*rollup.partials()))
    return partials.join(touched, ["topic_id", "date"], "left_anti").unionByName(again)


def windowed_partials(classified: DataFrame, window: str = "6 hours",
                      watermark: str | None = None) -> DataFrame:
    """T4: stage one of the 6-hour rollup as a streaming aggregate (sums that combine exactly).
    Without a watermark no row is late."""
    ts = F.timestamp_seconds(F.col("created_utc"))
    rows = classified.withColumn("event_time", ts)
    if watermark is not None:
        rows = rows.withWatermark("event_time", watermark)
    return (rows.groupBy(F.window("event_time", window).alias("w"), "topic_id", "stance")
            .agg(*rollup.partials())
            .select("topic_id", F.col("w.start").alias("bucket_start"), "stance", "cnt", "tox_units", "tox_n"))


def stance_window_partials(classified: DataFrame, window: str = "1 day",
                           watermark: str | None = None) -> DataFrame:
    """T5: counts and toxicity sums per stance and window as a streaming aggregate."""
    rows = classified.withColumn("event_time", F.timestamp_seconds(F.col("created_utc")))
    if watermark is not None:
        rows = rows.withWatermark("event_time", watermark)
    return (rows.groupBy(F.window("event_time", window).alias("w"), "stance")
            .agg(*rollup.partials())
            .select(F.col("w.start").alias("bucket_start"), "stance", F.col("cnt").alias("n_comments"),
                    F.col("tox_n").alias("n_scored"), "tox_units"))


def run_capped(stream: DataFrame, name: str, key: str, order: list[str], cap: int,
               work: str | None = None) -> DataFrame:
    """One running cap per key across micro-batches, kept in Spark's own state.

    Each key's state is the number of its rows seen; a micro-batch's rows of a
    key are taken in ``order``, and those within ``cap`` go out with their
    running number. The sink is append-only Parquet, so a restart from the
    same ``work`` continues where the last run ended.
    """
    import pandas as pd

    schema = StructType([*stream.schema.fields, StructField("running", LongType())])

    def within(keys, frames, state):
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        seen = state.get[0] if state.exists else 0
        rows["running"] = range(seen + 1, seen + len(rows) + 1)
        state.update((seen + len(rows),))
        yield rows[rows["running"] <= cap]

    capped = stream.groupBy(key).applyInPandasWithState(
        within, schema, "seen long", "append", GroupStateTimeout.NoTimeout)
    return run_append(capped, name, work)
