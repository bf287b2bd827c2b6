"""Packing token sequences by reciprocal-capacity (harmonic) classes.

A document's ids (its text's, then the end id) are cut greedily into pieces of
``capacity`` // k tokens: the largest such length that still fits, again on
what is left. A piece of class k fills exactly one k-th of a sequence, so a
sequence of class k takes k pieces of its class and wastes fewer than k ids
of room. Each task fills its own sequences, one open sequence per class, and
holds nothing but the pieces of those; no rows are exchanged. What is in the
open sequences when the task ends (fewer than ``capacity`` ids per class, and
capacity has about 2 * sqrt(capacity) classes) is laid end to end and cut at
``capacity``; the last part, shorter than that, is cut into powers of two,
which need no padding. Sequence ids are the task's number << 40 plus a count.

A null or empty text is one piece: the end id. Repeated rows are packed as
often as they come; a null id stays null; an empty table gives no rows. A text
of any length is encoded whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from agora.llm.common import WordCache, byte_slices, id_text, prepare, strings

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


def _ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4 or sys.byteorder != "little":
        return b"".join([i.to_bytes(4, "little") for i in ids])
    return out.tobytes()


def _byte_level(text: str) -> str:
    """A text's UTF-8 bytes as the characters byte-level vocabularies write them with."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return "".join(chr(b) if b in own else chr(256 + rest.index(b)) for b in text.encode())


class WordEncoder:
    """Ids of a text under a tokenizers file whose words end at white space and are lower-cased.

    ASCII letters are lower-cased and the text is cut at ASCII white space
    first, which that vocabulary does anyhow; the library then encodes each
    distinct part once per worker. A part of Latin-1 letters and trailing ASCII
    marks is one word and one run of marks there: letters go straight to the
    library's merges, spelled as its byte-level characters (checked when it is loaded).
    A text that could hold a special token, or
    a vocabulary of another make, is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = ["Ab c", "ab", "c", "a  b\tc", "a", "b", "ab,", ","]
        ids = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in probe]
        self.by_word = (ids[0] == ids[1] + ids[2] and ids[3] == ids[4] + ids[5] + ids[2]
                        and ids[6] == ids[1] + ids[7])
        self.tokenize = self.tokenizer.model.tokenize  # its letters are byte-level characters
        self.spelled = {c: _byte_level(chr(c)) for c in range(0xDF, 0x100) if chr(c).islower()}
        sample = "".join(map(chr, self.spelled))
        words = [*sample, sample, "a" + sample[::-1] + "z", *(x + y for x, y in zip(sample, sample.upper().replace("SS", "")))]
        if any(self._letters(w.lower()) != self._whole(w) for w in words):
            self.spelled = {}
        letters = "a-z" + ("\xc0-\xd6\xd8-\xde" + re.escape("".join(map(chr, self.spelled))) if self.spelled else "")
        self.plain_word = re.compile(f"([{letters}]+)([!-&(-/:-@\\[-`{{-~]*)").fullmatch
        self.special = [t.content[:2].encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = WordCache(self._part, 250_000)

    def _whole(self, text: str) -> bytes:
        return _ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes:
        """Ids of one lower-case word of plain letters."""
        return _ids([t.id for t in self.tokenize(word if word.isascii() else word.translate(self.spelled))])

    def _part(self, part: bytes) -> bytes:
        if not part:
            return b""
        text = part.decode()
        if hit := self.plain_word(text):
            word, marks = hit.groups()
            if not marks:
                return self._letters(word if part.isascii() else word.lower())
            key, cache = part[:-len(marks)], self.cache
            known = cache.get(key) or cache.old.get(key)  # not stored for its own sake: most such words come once
            return (known or self._letters(word if part.isascii() else word.lower())) + cache[marks.encode()]
        return self._whole(text)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        data = text.encode()
        if not self.by_word or any(s in data for s in self.special):
            return self._whole(text)
        return b"".join(map(self.cache.__getitem__, data.lower().replace(b"\n", b" ").split(b" ")))


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def cuts(n: int, capacity: int) -> Iterator[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    while n >= capacity:
        yield capacity
        n -= capacity
    while n > 0:
        size = capacity // -(-capacity // n)  # the largest capacity // k that is at most n
        yield size
        n -= size


class Packer:
    """One task's sequences. Pieces are (document row, start, length)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def _id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc, ids: bytes, n: int) -> Iterator[tuple]:
        start = 0
        for size in cuts(n, self.capacity):
            bin_ = self.open.setdefault(size, [])
            bin_.append((doc, start, size, ids[4 * start:4 * (start + size)], n))
            start += size
            if len(bin_) == self.capacity // size:
                yield from self._close(self.open.pop(size))

    def _close(self, pieces: list) -> Iterator[tuple]:
        sequence, offset = self._id(), 0
        for doc, start, size, ids, n in pieces:
            yield doc, start, size, ids, n, sequence, offset
            offset += size

    def rest(self) -> Iterator[tuple]:
        """Sequences of what is left: full ones, then powers of two."""
        pieces = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        self.open = {}
        left = sum(p[2] for p in pieces)
        room, group = 0, []
        for doc, start, size, ids, n in pieces:
            while size:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
                    left -= room
                take = min(size, room)
                group.append((doc, start, take, ids[:4 * take], n))
                start, size, ids, room = start + take, size - take, ids[4 * take:], room - take
                if not room:
                    yield from self._close(group)
                    group = []


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit) and its place."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])
    end = end_id.to_bytes(4, "little")
    prepare(df.sparkSession)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        encode = encoder(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in byte_slices(batch, "text", 4 << 20):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text"))):
                    ids = encode(text) + end
                    rows.extend(packer.add(doc, ids, len(ids) // 4))
                yield table(rows)
        yield table(list(packer.rest()))
    return id_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
