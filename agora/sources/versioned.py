"""Stored tables that change by whole commits: keyed upserts (S7, S8, T2), replaced groups.

A table is a folder of Parquet files dealt into buckets by a hash of its key.
A commit writes new files for the buckets it touches, next to the old ones,
and then one small file, the version, that says for every table and bucket
which files hold it. Only that last file, written and renamed by one task,
makes the commit visible: a failure before it leaves the old state, and a
version that is there already is not written again, so a replayed batch
changes nothing. Several tables change in one commit. Readers take the
newest version; files no version of the last ``keep`` uses may be deleted.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from agora.operators import ingest

_VERSION = T.StructType([T.StructField("version", T.LongType()), T.StructField("table", T.StringType()),
                         T.StructField("bucket", T.IntegerType()), T.StructField("written", T.LongType())])


class Tables:
    """Tables of one folder; ``schemas``: their columns, ``keys``: the columns their rows are dealt by."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType | str],
                 keys: dict[str, list[str]], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schemas = {t: T.StructType.fromDDL(x) if isinstance(x, str) else x for t, x in schemas.items()}

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_VERSION).json(f"{self.path}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def state(self) -> tuple[int, dict[tuple[str, int], int]]:
        """The newest version and, per table and bucket, the version that wrote it; -1 and nothing at first."""
        versions = self._versions()
        newest = versions.agg(F.max("version")).first()[0] if versions is not None else None
        if newest is None:
            return -1, {}
        rows = versions.where((F.col("version") == newest) & F.col("table").isNotNull()).collect()  # one per bucket
        return newest, {(r.table, r.bucket): r.written for r in rows}

    def bucket(self, table: str) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, held: dict[tuple[str, int], int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/written={w}/bucket={b}" for (t, b), w in sorted(held.items())
                 if t == table and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def read(self, table: str) -> DataFrame:
        return self._read(table, self.state()[1])

    def commit(self, version: int, changes: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> bool:
        """Change tables together. Per table: rows whose keys name the buckets to rewrite, and a function from
        those buckets' stored rows to their new ones. False if the version is there already."""
        newest, held = self.state()
        if version <= newest:
            return False
        for table, (touching, change) in changes.items():
            touched = {r.b for r in touching.select(self.bucket(table).alias("b")).distinct().collect()}  # <= buckets
            if not touched:
                continue
            names = self.schemas[table].fieldNames()
            now = change(self._read(table, held, touched)).select(*names, self.bucket(table).alias("bucket"))
            now.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(
                f"{self.path}/{table}/written={version}")
            written = self._written(table, version)
            for b in touched:
                held.pop((table, b), None)
                if b in written:
                    held[(table, b)] = version
        self._point(version, held)
        return True

    def _written(self, table: str, version: int) -> set[int]:
        """Buckets that have rows in this version's files."""
        rows = self.spark.read.schema(T.StructType([*self.schemas[table].fields, T.StructField("bucket", T.IntegerType())]))
        return {r.bucket for r in rows.parquet(f"{self.path}/{table}/written={version}").select("bucket").distinct().collect()}

    def _point(self, version: int, held: dict[tuple[str, int], int]) -> None:
        rows = [(version, t, b, w) for (t, b), w in held.items()] or [(version, None, None, None)]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.mode("append").json(f"{self.path}/versions")


def upsert(tables: Tables, version: int, table: str, incoming: DataFrame, refresh: list[str], newer: str) -> bool:
    """Insert new keys whole, refresh only the ``refresh`` columns of known ones, and those only from
    rows whose ``newer`` column is not older than what is stored. Of several incoming rows of a key the newest counts."""
    keys = tables.keys[table]
    latest = ingest.dedup_latest(incoming, keys, newer)
    return tables.commit(version, {table: (latest, lambda stored: ingest.upsert(
        stored, latest, keys, refresh, newer).drop("merge_status"))})


def upsert_stream(stream: DataFrame, tables: Tables, table: str, refresh: list[str], newer: str, checkpoint: str) -> None:
    """Every micro-batch is one commit, named by its id; the same checkpoint resumes."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(tables, batch_id, table, batch, refresh, newer)

    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def replace_clusters(tables: Tables, version: int, processed: DataFrame, clusters: DataFrame,
                     assignments: DataFrame) -> bool:
    """In one commit the processed topics' clusters are replaced and their members' assignments
    set anew, null for those that are in no cluster any more. ``processed``: topic_id; ``assignments``:
    topic_id, comment_id, cluster. Other topics keep theirs."""
    topics = processed.select("topic_id").distinct()

    def new_clusters(stored: DataFrame) -> DataFrame:
        return stored.join(topics, "topic_id", "left_anti").unionByName(clusters.join(topics, "topic_id", "left_semi"))

    def new_assignments(stored: DataFrame) -> DataFrame:
        others = stored.join(topics, "topic_id", "left_anti")
        mine = stored.join(topics, "topic_id", "left_semi").select("topic_id", "comment_id")
        known = assignments.join(topics, "topic_id", "left_semi").select("topic_id", "comment_id", "stance", "cluster")
        return others.unionByName(mine.join(known, ["topic_id", "comment_id"], "full_outer").select(*stored.columns))

    return tables.commit(version, {"clusters": (topics, new_clusters), "assignments": (topics, new_assignments)})
