"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from agora.session import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """What an operator needs of a session: a checkpoint folder, and this package on the executors."""
    ensure_checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="agora-"), "agora.zip")  # Spark sends it to the executors
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("agora", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(target)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (id, text) under fixed names, so no other column can clash; null text -> ''."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``mod`` (null id: hashed as '')."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def release() -> None:
    """Give what this worker has freed back to the system; workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


#: Bytes of an Arrow batch that leaves the JVM for a task that carries whole rows along.
ROW_BATCH = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ROW_BATCH`` bytes from here on (one row at least)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ROW_BATCH))


def byte_slices(batch: pa.RecordBatch, column: str, target: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``target`` bytes of ``column`` each (one row at least)."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n or 0
        if total >= target:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
                schema: str | StructType, target: int = 4 << 20) -> DataFrame:
    """mapInArrow over byte-balanced batches; ``make()`` builds the per-task function."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  (registers pa.compute)
        f = make()
        for batch in batches:
            for part in byte_slices(batch, "text", target):
                yield f(part)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]],
             fields: list[StructField]) -> DataFrame:
    """``row`` (all columns of ``df``) beside the columns that ``make()``'s function finds for the texts.

    The text crosses to Python once, inside the row, in batches bounded by bytes; a null text is ''.
    """
    prepare(df.sparkSession)
    bounded_batches(df.sparkSession)
    packed = df.select(F.struct("*").alias("row"))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            row = batch.column("row")
            texts = strings(row.field("text").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([row, *f(texts)], names=["row", *names])
        del f
        release()
    return packed.mapInArrow(run, StructType([packed.schema["row"], *fields]))


#: Rows of a small side up to which it is broadcast; it is counted first.
BROADCAST_ROWS = 50_000


def with_blocks(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``rows`` with ``blocks``: into how many blocks a key's rows are split so that each has about ``block``.

    Keys are counted with partial sums; the few large ones come back by a
    broadcast if they are few indeed, so no key's rows gather for this.
    """
    large = (rows.groupBy(*keys).count().where(F.col("count") > block)
             .select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks")).checkpoint())
    n = large.count()
    if not n:
        return rows.withColumn("blocks", F.lit(1))
    if n <= BROADCAST_ROWS:
        large = F.broadcast(large)
    return rows.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


class WordCache(dict):
    """word -> value, filled by ``compute`` on a miss; two generations bound its size.

    When the young generation reaches ``limit`` it becomes the old one, whose
    entries move back up when used: frequent words stay, memory is bounded.
    """

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
