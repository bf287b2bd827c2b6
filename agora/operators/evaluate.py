"""Classifier evaluation against manual labels.

Confusion counts, per-class precision / recall / F1, macro and micro
averages and accuracy are all aggregations of one (y_true, y_pred) count
table; no zip-by-position, no driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_COLUMNS = ["id", "external_id", "topic_id", "post_id", "target_terms", "body",
                 "stance", "sentiment", "toxicity", "notes"]
REQUIRED_COLUMNS = {"body", "target_terms", "stance", "sentiment", "toxicity"}


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts per observed (y_true, y_pred)."""
    return pairs.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p, r):
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def classification_report(pairs: DataFrame, task: str) -> DataFrame:
    """A17/A18/U3 for one task; ``pairs`` has (y_true, y_pred)."""
    return classification_reports(pairs.withColumn("task", F.lit(task)))


def classification_reports(pairs: DataFrame) -> DataFrame:
    """A17/A18/U3 for all tasks at once; ``pairs`` has (task, y_true, y_pred).

    Per task one row per label over the union of true and predicted labels,
    plus macro, micro and accuracy rows; values rounded to 4 dp; 0.0 on empty
    denominators; ``n_evaluated`` is the task's number of pairs. Every pair
    counts once for its true and once for its predicted label, so one
    aggregation of the pairs gives all metrics.
    """
    same = F.col("y_true") == F.col("y_pred")
    sides = F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("support"), F.lit(0).alias("predicted"),
                             same.cast("int").alias("tp")),
                    F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("support"), F.lit(1).alias("predicted"),
                             F.lit(0).alias("tp")))
    counts = (pairs.select("task", F.explode(sides).alias("s")).select("task", "s.*").groupBy("task", "label")
              .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]))
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    per = counts.select("*", p.alias("precision"), r.alias("recall")).withColumn("f1", _f1(p, r))
    tp = F.sum("tp")
    micro_p, micro_r = _ratio(tp, F.sum("predicted")), _ratio(tp, F.sum("support"))
    accuracy = _ratio(tp, F.sum("support"))

    def row(kind, precision, recall, f1):
        return F.struct(F.lit(kind).alias("kind"), F.lit(kind).alias("label"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1"))
    overall = per.groupBy("task").agg(
        F.sum("support").cast("bigint").alias("n_evaluated"),
        row("macro", F.avg("precision"), F.avg("recall"), F.avg("f1")).alias("macro"),
        row("micro", micro_p, micro_r, _f1(micro_p, micro_r)).alias("micro"),
        row("accuracy", accuracy, accuracy, accuracy).alias("accuracy"))
    totals = overall.select("task", "n_evaluated", F.explode(F.array("macro", "micro", "accuracy")).alias("m")).select(
        "task", "m.*", "n_evaluated")
    classes = per.join(overall.select("task", "n_evaluated"), "task").select(
        "task", F.lit("class").alias("kind"), "label", "precision", "recall", "f1", "n_evaluated")
    return classes.unionByName(totals).select(
        "task", "kind", "label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "n_evaluated")


def nested_report(report: DataFrame) -> DataFrame:
    """One row per task - n_evaluated, and its metrics as a map from label to (precision, recall, f1)."""
    entry = F.struct("label", F.struct("precision", "recall", "f1").alias("metrics"))
    return report.groupBy("task").agg(F.max("n_evaluated").alias("n_evaluated"),
                                      F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"))


def toxicity_mae(pairs: DataFrame) -> DataFrame:
    """Mean |label/3 - score| with manual labels on a 0-3 scale."""
    return pairs.agg(F.count(F.lit(1)).alias("n"),
                     F.round(F.avg(F.abs(F.col("label") / 3.0 - F.col("score"))), 4).alias("mae"))


def labelled_counts(labelled: DataFrame) -> DataFrame:
    """Rows with a non-blank label, per task."""
    def ok(c):
        return F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return labelled.agg(ok("stance").alias("stance"), ok("sentiment").alias("sentiment"),
                        ok("toxicity").alias("toxicity"))


def labelling_sample(comments: DataFrame, posts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Seeded sample of n eligible comments with blank label
    columns. Deterministic (hash order); not bit-equal to Python's sampler.
    The limit is the feature: a sample of n rows is requested."""
    j = (comments.where(F.col("body").isNotNull() & (F.col("body") != ""))
         .join(posts.select("post_id", "target_terms"), "post_id"))
    at = F.md5(F.concat(F.lit(f"{seed}:"), F.col("comment_id").cast("string")))
    picked = j.orderBy(at, "comment_id").limit(n)
    return picked.select(F.col("comment_id").alias("id"), "external_id", "topic_id", "post_id",
                         F.coalesce("target_terms", F.lit("")).alias("target_terms"), "body",
                         *[F.lit("").alias(c) for c in ("stance", "sentiment", "toxicity", "notes")])


def read_labelled_csv(spark, path: str) -> DataFrame:
    """Labelled CSV with the required-column check."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = REQUIRED_COLUMNS - set(df.columns)
    if missing:
        raise ValueError(f"missing columns in CSV: {sorted(missing)}")
    return df
