"""Byte-level BPE: encoding by a priority queue over a linked symbol list, and decoding.

Encoding. A text is cut into words by the vocabulary's split pattern; a word
starts as the ids of its bytes in a doubly linked list (two index arrays). All
mergeable neighbours enter a heap by rank, then position; the lowest, leftmost
first, is merged by relinking, and the two new neighbours enter the
heap. An entry is stale, and skipped, if its position is dead or its pair's
rank is another by now. n symbols cost O(n log n), so a word of any length is
whole. Words recur: each worker keeps the ids of words and of space-separated
parts in bounded caches. Decoding concatenates the vocabulary's byte strings;
bytes that are not UTF-8 become U+FFFD.

A special token's string inside a text is that token, as in the library's
default. Null or empty text: no ids, empty text back. Repeated rows give one
row each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from agora.llm.common import WordCache, id_text, map_batches, strings

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
# The split pattern of byte-level vocabularies and Unicode's White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+"
                r"|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+")


def printable_bytes() -> dict[str, int]:
    """char -> byte: visible Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """Encoder and decoder for a byte-level BPE vocabulary in a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*vocab.values(), *special.values())
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        for content, i in special.items():
            self.bytes_of[i] = content.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.of_byte = [0] * 256
        for i, b in enumerate(self.bytes_of):
            if len(b) == 1 and i not in special.values():
                self.of_byte[b[0]] = i
        #: by left id: right id -> rank << 20 | id of the merged symbol
        self.merges = [{} for _ in range(size)]
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left]].setdefault(vocab[right], rank << 20 | vocab[left + right])
        self.find_words = regex.compile(WORD_PATTERN).findall
        self.space_after_space = re.compile("[" + WHITE + "\x1c-\x1f] ").search
        self.cut_special = (re.compile("(" + "|".join(
            re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split
            if special else None)
        self.words = WordCache(self._word)
        self.parts = WordCache(self._part)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to one word's symbols."""
        n, table = len(symbols), self.merges
        heap, left = [], symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if right in table[left]:
                heap.append(table[left][right] << 32 | i - 1)
            left = right
        if not heap:
            return symbols
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j >= n or table[left].get(symbols[j]) != entry >> 32:
                continue
            symbols[i], symbols[j] = made, _ = entry >> 32 & 0xFFFFF, -1
            found, k = table[made], after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (right := symbols[k]) in found:
                    heappush(heap, found[right] << 32 | i)
            h = before[i]
            if h >= 0 and made in (found := table[symbols[h]]):
                heappush(heap, found[made] << 32 | h)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> bytes:
        of = self.of_byte
        return b"".join([self.packed[s] for s in self.merge([of[b] for b in word.encode()])])

    def _part(self, part: str) -> bytes:
        if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):
            return self._word(part)
        return b"".join(map(self.words.__getitem__, self.find_words(part)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. A space behind no white space starts a word,
        so the text falls apart there and its parts are looked up."""
        if self.space_after_space(text):
            return b"".join(map(self.words.__getitem__, self.find_words(text)))
        first, *rest = text.split(" ")
        get = self.parts.__getitem__
        return get(first) + b"".join([get(" " + p) for p in rest])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut_special is None:
            return self._plain(text)
        pieces = self.cut_special(text)
        if len(pieces) == 1:
            return self._plain(text)
        return b"".join(self.special[p] if i % 2 else self._plain(p)
                        for i, p in enumerate(pieces) if p)

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def codec(path: str) -> ByteBPE:
    """The codec for a vocabulary file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row; ids are little-endian unsigned 32-bit."""
    def make():
        bpe = codec(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [bpe.encode(t) for t in strings(batch.column("text"))]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"])
        return run
    return map_batches(id_text(df, id_col, text_col), make, SCHEMA)
