"""Token counts: batch encoding in Arrow functions that return lengths only.

The record batches of a task are re-cut into runs of about ``batch_bytes``
bytes, so a few very long texts do not make one batch heavy, and every text is
split where no merge can cross: at a single space between two other
characters. No piece of the vocabulary holds the space mark behind another
character (checked when the model is loaded), and the model puts one space
mark before every string it encodes, which stands for the space taken out; so
the parts' lengths add up to the whole text's. Parts recur, so each worker
keeps lengths by part in a bounded cache.

Null or empty text: 0 tokens. A vocabulary without the property, or a text with
a literal space mark, is encoded whole. Rows are never merged: repeated ids or
texts give one row each; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from agora.llm.common import WordCache, id_text, map_batches, strings

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_SINGLE_SPACE = re.compile(r"(?<=[^ ]) (?=[^ ])")


class PieceCounter:
    """Number of pieces of a text under a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = self.model.encode(["a b", "a", "b", " a"])
        self.splits = (not any(MARK in p.lstrip(MARK) for p in pieces)
                       and probe[0] == probe[1] + probe[2] and probe[3] != probe[1])
        self.cache = WordCache(self._pieces)

    def _pieces(self, part: str) -> int:
        return len(self.model.encode(part))

    def parts(self, text: str) -> list[str]:
        if not self.splits or MARK in text:
            return [text]
        if "  " in text or text.startswith(" ") or text.endswith(" "):
            return _SINGLE_SPACE.split(text)
        return text.split(" ")

    def __call__(self, text: str) -> int:
        return sum(map(self.cache.__getitem__, self.parts(text))) if text else 0


class JsonCounter:
    """Number of ids of a text under a tokenizers file (whole texts, no cache)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


_LOADED: dict[str, Callable[[str], int]] = {}


def counter(path: str) -> Callable[[str], int]:
    """The counter for a vocabulary file, loaded once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _LOADED[path]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``df``."""
    def make():
        count = counter(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column("text"))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64()),
                 pa.array([count(t) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])
        return run
    return map_batches(id_text(df, id_col, text_col), make, SCHEMA, batch_bytes)
