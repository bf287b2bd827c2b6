"""A weighted graph of words in packed blocks, over which scores spread round by round (M2).

Words are dealt by hash into blocks of a bounded number of edges. A block holds its words in order, their edges as
numpy arrays (the neighbour's place and the weight) and, for every other block that asks, which of its words' scores
that block needs. The blocks are dealt once, cached and stay where they are. In a round a block sends each asker the
scores it needs, packed in the order agreed on, and takes the weighted means over what it gets: one shuffle of 8
bytes per pair of a word and a block that it has a neighbour in. A word that meets a third of all others is one score
to send to each block, and its own edges are one run of an array.

Words may be of any type that Spark hashes and Arrow sorts. A neighbour without a score of its own counts as 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.common import prepare, release
from agora.operators.wordtexts import kept

OWN, EDGES, ASK, SEND = range(4)
#: A block has up to BLOCK edges on average; small graphs are dealt to up to SPREAD blocks. Beyond SPREAD tasks, a task
#: has two blocks, which it takes one after the other.
BLOCK, SPREAD, SPREAD_BLOCK = 1 << 20, 16, 1 << 18
#: Edges of a row, so that no row is large.
SLICE = 1 << 18
MAIL = "block int, far int, values binary, moved double"


def block_keys(spark, count: int, tasks: int) -> list[int]:
    """``count`` different integers that Spark's hash deals evenly to ``tasks`` partitions."""
    turns = math.ceil(count / tasks)
    some = spark.range(tasks * (8 * turns + 2 * tasks.bit_length())).select(F.col("id").cast("int").alias("key"))
    found = (some.groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("at"))
             .agg(F.slice(F.sort_array(F.collect_list("key")), 1, turns).alias("keys")).collect())
    keys = [r["keys"][turn] for turn in range(turns) for r in sorted(found) if len(r["keys"]) > turn][:count]
    taken = set(keys)
    spare = (k for k in range(2 * count) if k not in taken)
    return sorted([*keys, *(next(spare) for _ in range(count - len(keys)))])


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Every value as a place in the sorted distinct values."""
    import pyarrow.compute as pc  # noqa: PLC0415

    column = pa.chunked_array(column.chunks, type=column.type).combine_chunks()
    found = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    order = pc.sort_indices(found.dictionary)
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return place[found.indices.to_numpy()], found.dictionary.take(order)


def numbers(data, kind) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), kind)


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)],
                                schema=schema)


def packer(schema: pa.Schema):
    """Rows of one block from its edges and its seeds: its words, slices of its edges, and what it asks of others."""
    def pack(edges: pa.Table, seeds: pa.Table) -> pa.Table:
        import pyarrow.compute as pc  # noqa: PLC0415

        key = (edges if edges.num_rows else seeds).column("block")[0].as_py()
        both = pa.chunked_array([*edges.column("word").chunks, *seeds.column("word").chunks], type=edges.schema.field("word").type)
        at, words = coded(both)
        row, n = at[:edges.num_rows], len(words)
        seed = np.full(n, np.nan)
        seed[at[edges.num_rows:]] = seeds.column("seed").to_numpy()
        size = edges.column("size").to_numpy()
        near, others = coded(edges.column("neighbour"))
        far = np.zeros(len(others), np.int32)
        far[near] = edges.column("far").to_numpy()
        by_far = np.argsort(far, kind="stable")  # the answers come block by block, each in the words' order
        place = np.empty(len(others), np.int32)
        place[by_far] = np.arange(len(others), dtype=np.int32)
        col = place[near]
        del both, near, place
        order = np.argsort(row.astype(np.int64) * (len(others) + 1) + col, kind="stable")
        counts = np.bincount(row, minlength=n)
        whole = np.bincount(row[order], weights=size[order], minlength=n)
        rows = [(key, OWN, 0, seed.tobytes(), whole.tobytes(), counts.astype("<u4").tobytes(), words)]
        for i in range(0, len(order), SLICE):
            part = order[i:i + SLICE]
            rows.append((key, EDGES, i // SLICE, col[part].astype("<u4").tobytes(), size[part].astype("<f8").tobytes(), None, None))
        others, ends = others.take(pa.array(by_far)), np.flatnonzero(np.diff(far[by_far], append=-1, prepend=-1))
        for i, j in zip(ends[:-1], ends[1:]):
            rows.append((key, ASK, int(far[by_far[i]]), None, None, None, others.slice(i, j - i)))
        found = table(rows, schema)
        del rows, row, col, order, size
        release()
        return found
    return pack


def finder(schema: pa.Schema):
    """For every block that asks, the places of the words it wants; -1 for a word that has no score."""
    def find(own: pa.Table, asks: pa.Table) -> pa.Table:
        import pyarrow.compute as pc  # noqa: PLC0415

        rows = []
        for i in range(asks.num_rows):
            wanted = asks.column("words")[i].values
            at = pc.index_in(wanted, value_set=own.column("words")[0].values) if own.num_rows else pa.nulls(len(wanted), pa.int32())
            rows.append((asks.column("block")[i].as_py(), SEND, asks.column("far")[i].as_py(),
                         pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype("<i4").tobytes(), None, None))
        return table(rows, schema)
    return find


def advancer(schema: pa.Schema, first: bool, last: bool, shares: bool):
    """One round of a block: scores from what other blocks sent, unless ``first``; to them, unless ``last``.

    The scores at the start of the stride go along; the ``last`` round says how far the scores moved from them.
    """
    def advance(graph: pa.Table, mail: pa.Table) -> pa.Table:
        key = (graph if graph.num_rows else mail).column("block")[0].as_py()
        kinds, at = graph.column("kind").to_numpy(), graph.column("at").to_numpy()
        a, b, c = (graph.column(k) for k in "abc")
        own = [int(i) for i in np.flatnonzero(kinds == OWN)]
        if not own:  # asked, but without a word of its own: nothing has a score
            seed = whole = np.zeros(0)
            counts = np.zeros(0, np.int64)
        else:
            seed, whole, counts = numbers(a[own[0]], "<f8"), numbers(b[own[0]], "<f8"), numbers(c[own[0]], "<u4").astype(np.int64)
        froms, values = mail.column("far").to_numpy(), mail.column("values")
        kept = [numbers(values[int(i)], "<f8") for i in np.flatnonzero(froms == -1)]
        if first:
            score = kept[0] if kept else np.where(np.isnan(seed), 0.0, seed)
            saved = score
        else:
            saved = kept[0]
            slices = [int(i) for i in sorted(np.flatnonzero(kinds == EDGES), key=lambda i: at[i])]
            got = [numbers(values[int(i)], "<f8") for i in sorted(np.flatnonzero(froms != -1), key=lambda i: froms[i])]
            x, sums = np.concatenate([*got, np.zeros(0)]), np.zeros(len(seed))
            if slices:
                parts = np.concatenate([numbers(b[i], "<f8") * x[numbers(a[i], "<u4")] for i in slices])
                some = counts > 0
                sums[some] = np.add.reduceat(parts, (np.cumsum(counts) - counts)[some])
            mean = sums if shares else np.divide(sums, whole, out=np.zeros(len(sums)), where=whole != 0)
            score = np.where(np.isnan(seed), mean, seed)
        if last:
            moved = float(np.abs(score - saved).max()) if len(score) else None
            return table([(key, -1, score.tobytes(), moved)], schema)
        rows = [(key, -1, saved.tobytes(), None)]
        padded = np.append(score, 0.0)  # place -1
        for i in np.flatnonzero(kinds == SEND):
            rows.append((int(at[i]), key, padded[numbers(a[int(i)], "<i4")].tobytes(), None))
        return table(rows, schema)
    return advance


def unpacker(schema: pa.Schema):
    def unpack(own: pa.Table, state: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        if state.num_rows:
            score = numbers(state.column("values")[0], "<f8")
        else:
            seed = numbers(own.column("a")[0], "<f8")
            score = np.where(np.isnan(seed), 0.0, seed)
        return pa.Table.from_arrays([own.column("words")[0].values.cast(schema.field(0).type), pa.array(score)], schema=schema)
    return unpack


class Graph:
    """Packed blocks of ``edges`` (word, neighbour, share or weight), ``most`` in number if known, with the scores of
    ``seeds`` (word, seed)."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, most: int | None = None) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

        self.spark, self.arrow = edges.sparkSession, to_arrow_schema
        prepare(self.spark)
        self.shares = "share" in edges.columns
        size = F.col("share" if self.shares else "weight").cast("double").alias("size")
        self.kind = edges.schema["word"].dataType
        edges = kept(edges) if most is None else edges  # counted before they are dealt
        n = edges.count() if most is None else most
        self.count = max(1, math.ceil(n / BLOCK), min(SPREAD, math.ceil(n / SPREAD_BLOCK)))
        self.tasks = min(self.count, max(SPREAD, math.ceil(self.count / 2)))
        keys = F.array(*[F.lit(k) for k in block_keys(self.spark, self.count, self.tasks)])

        def block(word: Column) -> Column:
            return F.element_at(keys, (F.pmod(F.xxhash64(word), F.lit(self.count)) + 1).cast("int"))

        binaries = [T.StructField(k, T.BinaryType()) for k in "abc"]
        head = [T.StructField(k, T.IntegerType()) for k in ("block", "kind", "at")]
        parts = T.StructType([*head, *binaries, T.StructField("words", T.ArrayType(self.kind))])
        dealt = (edges.select(block(F.col("word")).alias("block"), "word", "neighbour", size).repartition(self.tasks, "block")
                 .select("block", block(F.col("neighbour")).alias("far"), "word", "neighbour", "size"))
        known = seeds.select(F.col("word").cast(self.kind).alias("word"), "seed").select(
            block(F.col("word")).alias("block"), "word", F.col("seed").cast("double").alias("seed"))
        self.parts = kept(dealt.groupBy("block").cogroup(known.groupBy("block"))
                            .applyInArrow(packer(to_arrow_schema(parts)), parts))
        self.own = self.parts.where(F.col("kind") == OWN).select("block", "a", "words")
        asks = self.parts.where(F.col("kind") == ASK).select(F.col("at").alias("block"), F.col("block").alias("far"), "words")
        rows = T.StructType([*head, *binaries])
        sends = self.own.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(finder(to_arrow_schema(rows)), rows)
        self.blocks = (self.parts.where(F.col("kind") != ASK).drop("words").union(sends)
                       .repartition(self.tasks, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK))
        self.mail = self.spark.createDataFrame([], MAIL)

    def advance(self, state: DataFrame | None, rounds: int) -> DataFrame:
        """The scores (one row per block) after ``rounds`` more rounds from ``state``, or from the seeds; moved: how far."""
        mail, arrow = self.mail if state is None else state, self.arrow(self.mail.schema)
        for done in range(rounds + 1):
            first, last = done == 0, done == rounds
            # the first takes no sums, the last sends nothing
            blocks = self.blocks.where(F.col("kind") != (EDGES if first else SEND)) if first or last else self.blocks
            mail = (blocks.groupBy("block").cogroup(mail.groupBy("block"))
                    .applyInArrow(advancer(arrow, first, last, self.shares), self.mail.schema))
        return kept(mail, at_once=False)

    def scores(self, state: DataFrame | None) -> DataFrame:
        """(word, score) of all words of the graph and all seeds."""
        schema = T.StructType([T.StructField("word", self.kind), T.StructField("score", T.DoubleType())])
        state = self.mail if state is None else state
        return (self.own.groupBy("block").cogroup(state.groupBy("block"))
                .applyInArrow(unpacker(self.arrow(schema)), schema))

    def release(self) -> None:
        self.blocks.unpersist()
