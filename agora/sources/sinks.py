"""Sinks (S11-S13, S15). Upserts that must keep other keys (S9, S10) are
anti-join + union plans in the operators; this module only writes.

Writes go to a new path and are then swapped in by the caller; a path that
is being read is never overwritten in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from agora.operators.evaluate import LABEL_COLUMNS


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Classifications, embeddings, clusters, daily stats."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_labelling_csv(sample: DataFrame, path: str) -> None:
    """Labelling sheet with the fixed column order and a header."""
    (sample.select(*LABEL_COLUMNS).write.mode("overwrite").option("header", True)
     .option("escape", '"').csv(path))


def write_report_json(report: DataFrame, path: str) -> None:
    """Evaluation report rows as JSON lines."""
    report.write.mode("overwrite").json(path)
