"""Cluster keywords: term-frequency fallback (A21) and mean TF-IDF over
unigrams + bigrams (M8, W4), for all groups in one job.

Term frequencies are an explode and an aggregate over the whole corpus. TF-IDF
deals a group's terms into buckets by hash and sends a document's terms there
packed, one row per document and bucket instead of one per term; a bucket knows
all occurrences of its terms, so document frequencies need no join. The
ranked cuts (500-term vocabulary, top-n keywords) are taken per bucket or task before the
shuffle, so a group holding a large share of all documents does not end up whole in one task.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from agora import lexicon
from agora.functions.text import tf_tokens, tfidf_tokens
from agora.session import ensure_checkpoint_dir

SCORE_DIGITS = 9  # scores are rounded before ranking so ties are exact
#: Text of a group per bucket of its terms, and bytes of an Arrow batch.
BLOCK_BYTES = 16 << 20
ROW_BATCH = 4 << 20
#: Groups up to which a row per group is broadcast.
BROADCAST_GROUPS = 100_000


def tf_keywords(docs: DataFrame, group: str, n: int = lexicon.N_KEYWORDS,
                stop=None) -> DataFrame:
    """Most frequent ``[a-z]{2,}`` tokens per group, stop words
    (English + extra) removed; ties keep first occurrence order."""
    stop = list(stop or lexicon.english_stop_words()) + lexicon.KEYWORD_EXTRA_STOP
    toks = docs.select(group, "doc_id", F.posexplode(tf_tokens(F.col("text"))).alias("pos", "term"))
    toks = toks.where(~F.col("term").isin(*dict.fromkeys(stop)))  # hash-set lookup
    counted = toks.groupBy(group, "term").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first"))
    w = Window.partitionBy(group).orderBy(F.desc("cnt"), F.asc("first"))
    return (counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(group, F.col("rank").cast("int"), "term",
                    F.col("cnt").cast("double").alias("score"),
                    F.lit("tf").alias("method")))


def postings(docs: DataFrame, group: str, stop=None) -> DataFrame:
    """(group, bucket, doc_id, n_docs, terms): a document's unigrams and bigrams, every occurrence, in one row per
    bucket, one per line. All occurrences of a term in a group lie in one bucket; a bucket holds the terms of about ``BLOCK_BYTES``
    of text, so what a task takes at a time is bounded however large a group is. The rows are written once.

    Stop words are removed before bigrams are formed. Rows without a group are left out."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ROW_BATCH))
    docs = docs.where(F.col(group).isNotNull())
    sizes = docs.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.greatest(F.ceil(F.sum(F.octet_length("text").cast("long")) / BLOCK_BYTES), F.lit(1)).cast("int").alias("buckets"))
    toks = _beside(docs, sizes, group).select(group, "doc_id", "n_docs", F.coalesce("buckets", F.lit(1)).alias("bucket"),
                                              F.array_join(tfidf_tokens(F.col("text")), "\n").alias("terms"))
    stops = pa.array(["", *(stop or lexicon.english_stop_words())], pa.string())  # '' is what no tokens split into

    def run(batches):
        for batch in batches:
            yield _split(batch, stops)
    toks.mapInArrow(run, toks.schema).write.parquet(folder)
    return spark.read.parquet(folder)


def _beside(docs: DataFrame, small: DataFrame, group: str, how: str = "inner") -> DataFrame:
    """``docs`` joined with one row per group. Those rows are written and counted first: up to ``BROADCAST_GROUPS``
    of them are broadcast and no text moves."""
    small = small.checkpoint()
    return docs.join(F.broadcast(small) if small.count() <= BROADCAST_GROUPS else small, group, how)


def _split(batch: pa.RecordBatch, stops: pa.Array) -> pa.RecordBatch:
    """Token rows -> rows by bucket, with bigrams. ``bucket`` comes in as the number of buckets."""
    lists, buckets = pc.split_pattern(batch.column("terms"), "\n"), batch.column("bucket").to_numpy()
    coded = lists.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    used = ~pc.is_in(words, value_set=stops).to_numpy(zero_copy_only=False)[code]
    code, row = code[used], row[used]
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
    follows = np.flatnonzero(row[1:] == row[:-1])
    left, right = code[follows], code[follows + 1]
    pair = (hashes[left] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[right]
    rows = np.concatenate([row, row[follows]])
    at = (np.concatenate([hashes[code], pair ^ (pair >> np.uint64(29))]) % buckets[rows].astype(np.uint64)).astype(np.int64)
    key = rows * (int(buckets.max(initial=0)) + 1) + at
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    terms = pa.concat_arrays([words.take(pa.array(code)),
                              pc.binary_join_element_wise(words.take(pa.array(left)), words.take(pa.array(right)), " ")])
    ends = pa.array(np.append(first, len(order)).astype(np.int32))
    kept = batch.take(pa.array(rows[order[first]]))
    return pa.RecordBatch.from_arrays(
        [*kept.columns[:3], pa.array(at[order[first]].astype(np.int32)),
         pc.binary_join(pa.ListArray.from_arrays(ends, terms.take(pa.array(order))), "\n")], names=batch.schema.names)


class Block:
    """The postings of one bucket of a group, all or those of a vocabulary."""

    def __init__(self, table: pa.Table, vocabulary: pa.Array | None = None):
        lists = pc.split_pattern(_one(table["terms"]), "\n")
        ids = _one(table["doc_id"]).dictionary_encode(null_encoding="encode")
        coded = _one(lists.flatten()).dictionary_encode()
        self.ids, self.terms, self.n_docs = ids.dictionary, coded.dictionary, table["n_docs"][0].as_py()
        self.code = coded.indices.to_numpy()
        self.at = np.repeat(ids.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy())
        if vocabulary is not None:
            known = pc.is_in(self.terms, value_set=vocabulary).to_numpy(zero_copy_only=False)[self.code]
            self.code, self.at = self.code[known], self.at[known]

    def frequencies(self) -> np.ndarray:
        """Occurrences of every term."""
        return np.bincount(self.code, minlength=len(self.terms))

    def weights(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of every pair that occurs, and the terms' idf."""
        pairs, tf = np.unique(self.at * len(self.terms) + self.code, return_counts=True)
        document, term = np.divmod(pairs, len(self.terms))
        df = np.bincount(term, minlength=len(self.terms))
        return document, term, tf, np.log((1.0 + self.n_docs) / (1.0 + df)) + 1.0


def _one(column) -> pa.Array:
    """A column as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _first(terms: pa.Array, among: np.ndarray, value: np.ndarray, n: int, ties: str) -> np.ndarray:
    """The ``n`` of the terms ``among`` with the largest values, ties by term."""
    if len(among) > n:
        among = among[value[among] >= np.partition(value[among], len(among) - n)[len(among) - n]]
    table = pa.table({"value": value[among], "term": terms.take(pa.array(among))})
    return among[pc.sort_indices(table, [("value", "descending"), ("term", ties)]).to_numpy()[:n]]


def _out(schema: StructType, table: pa.Table | None, n: int, **columns) -> pa.Table:
    """``n`` rows: the group's keys, and the columns."""
    kinds = to_arrow_schema(schema)
    keys = {k: pa.array([table[k][0].as_py()] * n, kinds.field(k).type) for k in kinds.names if k not in columns} if n else {}
    return pa.table([pa.array([], f.type) if not n else keys[f.name] if f.name in keys else _as(columns[f.name], f.type)
                     for f in kinds], schema=kinds)


def _as(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def tfidf_of(rows: DataFrame, group: str, n: int, max_features: int | None, extra_stop=None) -> DataFrame:
    """M8 over ``postings``: three (without ``max_features`` two) passes over the buckets.

    First the most frequent terms, of each bucket and then of the group; then the parts of the documents' squared norms,
    summed per document and sent back to the buckets that hold it; then the scores, of which the first n of
    a bucket are ranked in the group."""
    keys = [group, "bucket"]
    kind = {f.name: f for f in rows.schema}
    fields = lambda *more: StructType([kind[group], kind["bucket"], *more])
    term, doc = StructField("term", StringType()), kind["doc_id"]
    grouped = rows.groupBy(*keys)
    vocabulary = None
    if max_features is not None:
        frequent = fields(term, StructField("cf", LongType()))

        def count(table: pa.Table) -> pa.Table:
            block = Block(table)
            cf = block.frequencies()
            best = _first(block.terms, np.arange(len(block.terms)), cf, max_features, "ascending")
            return _out(frequent, table, len(best), term=block.terms.take(pa.array(best)), cf=cf[best])
        w = Window.partitionBy(group).orderBy(F.desc("cf"), F.asc("term"))
        vocabulary = (grouped.applyInArrow(count, frequent).withColumn("r", F.row_number().over(w))
                      .where(F.col("r") <= max_features).select(*keys, "term"))

    parts = fields(doc, StructField("part", DoubleType()))

    def squares(table: pa.Table, known: pa.Table | None = None) -> pa.Table:
        if not table.num_rows or known is not None and not known.num_rows:
            return _out(parts, None, 0)
        block = Block(table, None if known is None else _one(known["term"]))
        document, term, tf, idf = block.weights()
        part = np.bincount(document, weights=(tf * idf[term]) ** 2, minlength=len(block.ids))
        some = np.flatnonzero(part)
        return _out(parts, table, len(some), doc_id=block.ids.take(pa.array(some)), part=part[some])
    if vocabulary is None:
        found = grouped.applyInArrow(lambda table: squares(table), parts)
    else:
        found = grouped.cogroup(vocabulary.groupBy(*keys)).applyInArrow(lambda table, known: squares(table, known), parts)
    norms = (found.groupBy(group, "doc_id").agg(F.sqrt(F.sum("part")).alias("norm"), F.collect_list("bucket").alias("in"))
             .select(group, F.explode("in").alias("bucket"), "doc_id", "norm", F.lit(None).cast("string").alias("term")))
    told = norms if vocabulary is None else norms.unionByName(vocabulary, allowMissingColumns=True)

    extra = "(^| )(" + "|".join(map(re.escape, extra_stop or lexicon.KEYWORD_EXTRA_STOP)) + ")( |$)"
    ranked = fields(term, StructField("score", DoubleType()))

    def scores(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows or not known.num_rows:
            return _out(ranked, None, 0)
        has_norm = pc.is_valid(known["norm"])
        block = Block(table, None if max_features is None else _one(known.filter(pc.invert(has_norm))["term"]))
        known = known.filter(has_norm)
        if not known.num_rows:
            return _out(ranked, None, 0)
        document, term, tf, idf = block.weights()
        at = pc.index_in(block.ids, value_set=_one(known["doc_id"])).fill_null(0).to_numpy()
        norm = _one(known["norm"]).to_numpy()[at]  # every document with a term of the vocabulary here has one
        shares = np.bincount(term, weights=tf / norm[document], minlength=len(block.terms))
        score = np.round(idf * shares / block.n_docs, SCORE_DIGITS)
        some = np.unique(term)
        some = some[~pc.match_substring_regex(block.terms.take(pa.array(some)), extra).to_numpy(zero_copy_only=False)]
        best = _first(block.terms, some, score, n, "descending")
        return _out(ranked, table, len(best), term=block.terms.take(pa.array(best)), score=score[best])
    best = grouped.cogroup(told.groupBy(*keys)).applyInArrow(scores, ranked)
    wr = Window.partitionBy(group).orderBy(F.desc("score"), F.desc("term"))
    return (best.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= n)
            .select(group, F.col("rank").cast("int"), "term", "score", F.lit("tfidf").alias("method")))


def tfidf_keywords(docs: DataFrame, group: str, n: int = lexicon.N_KEYWORDS,
                   max_features: int | None = None, stop=None,
                   extra_stop=None) -> DataFrame:
    """M8: mean TF-IDF keywords per group.

    Stop words are removed before bigrams are formed; the vocabulary is
    every term of the group, or the ``max_features`` most frequent (ties by term); idf is
    smoothed, ln((1+n)/(1+df)) + 1; each document vector is L2-normalised
    over the vocabulary; the score is the sum over the group's documents
    divided by all of them (documents without terms count). Terms with an
    extra stop word are skipped after ranking; ties by term descending.
    Groups whose vocabulary is empty produce no rows (callers fall back).
    """
    return tfidf_of(postings(docs, group, stop), group, n, max_features, extra_stop)


def keywords(docs: DataFrame, group: str, n: int = lexicon.N_KEYWORDS, min_docs: int = 3,
             max_features: int | None = None) -> DataFrame:
    """M8 dispatch per group: no docs -> nothing; fewer than ``min_docs`` or an
    empty TF-IDF vocabulary -> term frequency; otherwise TF-IDF. Which groups
    have a vocabulary is seen from the written postings, not from the TF-IDF result."""
    rows = postings(docs, group)
    chosen = rows.where(F.col("n_docs") >= min_docs).select(group).distinct()
    rest = _beside(docs, chosen, group, "left_anti")
    return (tfidf_of(rows.where(F.col("n_docs") >= min_docs), group, n, max_features)
            .unionByName(tf_keywords(rest, group, n)))
