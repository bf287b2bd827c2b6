"""Removal of repeated byte strings in a corpus by prefix-free parsing.

Every string of ``length`` bytes that also starts earlier in the corpus (in a
document of smaller id, or further up in the same one) is removed, overlaps
included; strings never cross documents and are judged on the input.

Parsing. A rolling hash over ``gram`` bytes sets triggers: of every string of
``length`` bytes, the trigger is the place of its smallest hash, leftmost
first. Neighbouring strings mostly share their trigger; such a run, from its
first string's start to its last one's end, is a phrase. A string decides its
trigger alone, so equal strings lie at the same place behind the same trigger
gram, and only phrases of one trigger gram need to meet. The dictionary is
the set of distinct phrases, the parse the list of their places in corpus
order (id, then start).

Combining. In the parse, every place of a dictionary phrase but the first is
repeated as a whole: all of its strings start earlier there. That settles
most of a repetitive corpus without looking at a suffix. A trigger gram with
one phrase needs nothing more. Where a gram has several phrases (the ends of
a repeat, edits), the suffixes of their first places are put in order by
fingerprint, each standing for its leading ``length`` bytes, and those in a
group of equal ones but the first in corpus order are repeated.

Scale. Documents are dealt into chunks; per chunk, distinct grams, phrases and
suffixes go to shards by their hash and come back as one bit each (see
``exchange``). A very common gram sends one row per chunk, its phrases spread
by their own hash; nothing is gathered per gram. Hashes have 64 bits; phrases
are compared by gram and phrase hash, 128 bits together, suffixes by the
fingerprint mixed with their gram's.

Null text: empty. Texts shorter than ``length`` stay whole. Null ids come last
in corpus order; rows of the same id count as one document's, so equal places
of repeated rows do not remove each other. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agora.llm.common import id_text, prepare
from agora.llm.exchange import chunk_count, chunked, cuts, pack, unpack
from agora.llm.minhash import mix

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary"
LAST = np.iinfo(np.int64).max
_P = 0x5851F42D4C957F2D
_PI = pow(_P, -1, 1 << 64)


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 32
    chunk_bytes: int = 2 << 20
    segment: int = 1 << 19      # bytes of a chunk that are hashed at a time


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefix:
    """Polynomial hashes of all substrings of a buffer (modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = _powers(_PI, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, n + 1)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def parse(data: np.ndarray, valid: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Phrases of one segment: trigger gram hash, phrase hash, first and last start of their strings."""
    hashes = Prefix(data)
    grams = len(data) - s.gram + 1
    at = np.arange(grams)
    gram = hashes(at, at + s.gram)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, span = s.length - s.gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[valid]
    new = np.flatnonzero((np.diff(trigger) != 0) | (np.diff(valid) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(valid)]]) - 1
    lo, hi, place = valid[first], valid[last], trigger[first]
    shape = ((place - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    phrase = mix(hashes(lo, hi + s.length) + mix(shape))
    return {"gram": gram[place], "phrase": phrase, "lo": lo, "hi": hi, "hashes": hashes}


class Chunk:
    """A chunk's documents in corpus order and their phrases."""

    def __init__(self, table: pa.Table, s: Settings):
        ids = np.array([LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        texts = [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.s, self.rows = s, order
        self.ids = ids[order]
        self.null = [table["doc_id"][i].as_py() is None for i in order]
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
        self.found = [self._segment(at) for at in range(0, max(1, len(self.data)), s.segment)]
        get = lambda name, kind: np.concatenate([f[name] for f in self.found]) if self.found else np.zeros(0, kind)
        self.gram, self.phrase = get("gram", np.uint64), get("phrase", np.uint64)
        self.lo, self.hi = get("lo", np.int64), get("hi", np.int64)
        self.doc = np.searchsorted(self.starts, self.lo, "right") - 1
        # zero-length documents share a start; the last one there holds the bytes

    def _segment(self, at: int) -> dict[str, np.ndarray]:
        s, empty = self.s, {"gram": np.zeros(0, np.uint64), "phrase": np.zeros(0, np.uint64),
                            "lo": np.zeros(0, np.int64), "hi": np.zeros(0, np.int64)}
        stop = min(len(self.data), at + s.segment + s.length - 1)
        piece = self.data[at:stop]
        if len(piece) < s.length:
            return empty
        inside = np.zeros(len(piece) + 1, np.int64)  # +1 where a document's strings begin, -1 behind the last
        begin, end = self.starts[:-1], self.starts[1:] - s.length + 1
        fits = end > begin
        begin, end = (np.clip(x[fits] - at, 0, len(piece) - s.length + 1) for x in (begin, end))
        np.add.at(inside, begin, 1)
        np.add.at(inside, end, -1)
        valid = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(valid):
            return empty
        out = parse(piece, valid, s)
        return {"gram": out["gram"], "phrase": out["phrase"], "lo": out["lo"] + at, "hi": out["hi"] + at}

    def strings(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, fingerprint) of every string of the picked phrases."""
        sizes = self.hi[picked] - self.lo[picked] + 1
        if not len(sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = np.repeat(self.lo[picked], sizes) + offset
        gram = np.repeat(self.gram[picked], sizes)
        mark = np.empty(len(start), np.uint64)
        for at in range(0, len(self.data), self.s.segment):
            here = np.flatnonzero((start >= at) & (start < at + self.s.segment))
            if len(here):
                hashes = Prefix(self.data[at:at + self.s.segment + self.s.length])
                mark[here] = hashes(start[here] - at, start[here] - at + self.s.length)
        return start, mix(mark + gram * np.uint64(3))

    def earliest(self, keys: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys with their first (id, start within the document), and whether each
        given place is that first one."""
        doc = np.searchsorted(self.starts, start, "right") - 1
        ids, within = self.ids[doc], start - self.starts[doc]
        order = np.lexsort((within, ids, keys))
        key = keys[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)])) if len(key) else head
        first_id, first_at = ids[order][head], within[order][head]
        index = np.empty(len(keys), np.int64)
        index[order] = group
        return key[head], first_id, first_at, np.stack([index, ((ids == first_id[index]) & (within == first_at[index])).astype(np.int64)])


def phrase_key(gram: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    return mix(gram * np.uint64(5) + phrase)


def grams_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams, and 32 bits of the one phrase each has in the chunk (0: several).

    A gram whose phrases agree in these bits (one pair in 2**32) passes as having one.
    """
    order = np.lexsort((chunk.phrase, chunk.gram))
    gram, phrase = chunk.gram[order], chunk.phrase[order]
    head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    tail = np.concatenate([head[1:], [len(gram)]]) - 1 if len(head) else head
    return gram[head], np.where(phrase[head] == phrase[tail], phrase[head] >> np.uint64(32) | np.uint64(1), 0).astype(np.uint32)


def _ask(kind: int, chunk: int, shards: int, keys: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    ends, out = cuts(keys, shards), []
    for shard in range(shards):
        x, y = ends[shard], ends[shard + 1]
        if x < y:
            packed = [pack(c[x:y]) for c in columns]
            out.append((shard, kind, chunk, pack(keys[x:y], True), packed[0], packed[1] if len(packed) > 1 else None))
    return out


def _answers(rows: pa.Table, kind: int) -> np.ndarray:
    """A chunk's answers of one kind in the order of its keys."""
    picked = sorted((r["shard"], r["answer"]) for r in rows.to_pylist() if r["kind"] == kind)
    return np.concatenate([unpack(a, np.uint8) for _, a in picked]) if picked else np.zeros(0, np.uint8)


QUESTION = "shard int, kind int, chunk int, keys binary, x binary, y binary"
ANSWER = "shard int, kind int, chunk int, answer binary"
GRAM, PHRASE, STRING = 0, 1, 2


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, pa.binary() if n in ("keys", "x", "y", "answer") else pa.int32())
                     for n, c in zip(names, columns)})


def _reply(table: pa.Table) -> pa.Table:
    """A shard's answers: per gram 2 if it has several phrases, else 0; per phrase or string 1 if the
    chunk's first place is the corpus's."""
    out, every = [], table.to_pylist()
    for kind in sorted({r["kind"] for r in every}):
        rows = [r for r in every if r["kind"] == kind]
        keys = [unpack(r["keys"], np.uint64, True) for r in rows]
        sizes = [len(k) for k in keys]
        all_keys = np.concatenate(keys)
        if kind == GRAM:
            x = np.concatenate([unpack(r["x"], np.uint32) for r in rows])
            order = np.lexsort((x, all_keys))
        else:
            x, y = (np.concatenate([unpack(r[c], np.int64) for r in rows]) for c in ("x", "y"))
            order = np.lexsort((y, x, all_keys))
        key = all_keys[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        if kind == GRAM:
            tail = np.concatenate([head[1:], [len(key)]]) - 1
            several = (x[order][head] != x[order][tail]) | (x[order][head] == 0)
            verdict = np.where(several, 2, 0)[group].astype(np.uint8)
        else:
            verdict = ((x[order] == x[order][head][group]) & (y[order] == y[order][head][group])).astype(np.uint8)
        answer = np.empty(len(key), np.uint8)
        answer[order] = verdict
        ends = np.cumsum(sizes)
        out += [(r["shard"], kind, r["chunk"], pack(answer[e - n:e])) for r, n, e in zip(rows, sizes, ends)]
    return _table(out, ["shard", "kind", "chunk", "answer"])


def _verdicts(chunk: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Per phrase place: repeated as a whole; to be settled string by string."""
    grams, _ = grams_of(chunk)
    several = _answers(answers, GRAM)[np.searchsorted(grams, chunk.gram)] == 2
    _, _, _, (index, first_here) = chunk.earliest(phrase_key(chunk.gram, chunk.phrase), chunk.lo)
    first = (first_here == 1) & (_answers(answers, PHRASE)[index] == 1)
    return ~first, first & several


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings(),
                   carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (maximal removed runs) and kept bytes.

    With ``carry`` also ``row``, the input row as a struct, and ``kept_text``,
    the kept bytes as text without characters that a cut has split.
    """
    prepare(df.sparkSession)
    documents = id_text(df, id_col, text_col)
    if carry:
        documents = df.select(F.col(id_col).cast("long").alias("doc_id"),
                              F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                              F.struct(*[c for c in df.columns if c != text_col]).alias("row"))
    chunks = chunk_count(documents, s.chunk_bytes)
    shards = max(12, chunks // 4)
    dealt = chunked(documents, chunks)

    def ask_phrases(table: pa.Table) -> pa.Table:
        number, chunk = table["chunk"][0].as_py(), Chunk(table, s)
        if not len(chunk.lo):
            return _table([], QUESTION_NAMES)
        grams, one = grams_of(chunk)
        keys, ids, starts, _ = chunk.earliest(phrase_key(chunk.gram, chunk.phrase), chunk.lo)
        return _table(_ask(GRAM, number, shards, grams, one) + _ask(PHRASE, number, shards, keys, ids, starts),
                      QUESTION_NAMES)

    def ask_strings(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], QUESTION_NAMES)
        number, chunk = table["chunk"][0].as_py(), Chunk(table, s)
        if not len(chunk.lo):
            return _table([], QUESTION_NAMES)
        start, mark = chunk.strings(np.flatnonzero(_verdicts(chunk, answers)[1]))
        if not len(start):
            return _table([], QUESTION_NAMES)
        keys, ids, starts, _ = chunk.earliest(mark, start)
        return _table(_ask(STRING, number, shards, keys, ids, starts), QUESTION_NAMES)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, s)
        cover = np.zeros(len(chunk.data) + 1, np.int64)
        if len(chunk.lo):
            whole, open_ = _verdicts(chunk, answers)
            np.add.at(cover, chunk.lo[whole], 1)
            np.add.at(cover, chunk.hi[whole] + s.length, -1)
            start, mark = chunk.strings(np.flatnonzero(open_))
            if len(start):
                _, _, _, (index, first_here) = chunk.earliest(mark, start)
                later = start[(first_here == 0) | (_answers(answers, STRING)[index] == 0)]
                np.add.at(cover, later, 1)
                np.add.at(cover, later + s.length, -1)
        removed = np.cumsum(cover[:-1]) > 0
        out = []
        for i, (x, y) in enumerate(zip(chunk.starts[:-1], chunk.starts[1:])):
            gone = removed[x:y]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            out.append((None if chunk.null[i] else int(chunk.ids[i]), int(y - x), int(gone.sum()), len(edge) // 2,
                        [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])],
                        chunk.data[x:y][~gone].tobytes()))
        columns = list(zip(*out)) if out else [[]] * 6
        done = pa.table([pa.array(c, k) for c, k in zip(columns, OUT.types)], schema=OUT)
        if carry:
            done = done.append_column("row", table["row"].take(pa.array(chunk.rows, pa.int64())))
            done = done.append_column("kept_text", pa.array([r[5].decode("utf-8", "ignore") for r in out], pa.string()))
        return done

    schema = StructType.fromDDL(SCHEMA)
    if carry:
        schema = schema.add("row", documents.schema["row"].dataType).add("kept_text", "string")
    by_chunk = dealt.groupBy("chunk")
    first = by_chunk.applyInArrow(ask_phrases, QUESTION).groupBy("shard").applyInArrow(_reply, ANSWER)
    second = (by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(ask_strings, QUESTION)
              .groupBy("shard").applyInArrow(_reply, ANSWER))
    return by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(cut, schema)


QUESTION_NAMES = ["shard", "kind", "chunk", "keys", "x", "y"]
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                 ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def without_repeats(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``documents``, all columns and rows, with repeated byte strings taken out of ``text`` and
    ``n_chars``, if there, counted anew."""
    cut_ = remove_repeats(documents, s=s, carry=True)
    columns = [F.col("kept_text").alias(c) if c == "text"
               else F.length("kept_text").cast(documents.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col("row")[c].alias(c) for c in documents.columns]
    return cut_.select(*columns)
