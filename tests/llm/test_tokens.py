"""BPE codec, packing and token counts against the libraries, row by row."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import empty, odd, odd_rows
from tokenizers import Tokenizer

from agora.llm import bpe, packing, queries, token_counts

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def fuzz(n=1500):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", "a", "b", "é", "İ", "Σ", "ß", "1", "٣", "<|endoftext|>", "<|", "'s",
             "'LL", "don't", "!", "$$$", " ", "\xa0", "\x1c", "\x00", "😀", "世界", "ing", "THE", "▁", "<s>", "\x85",
             "_", "²", "É", "́", "Å"]
    return ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(n)] + ["", " ", "a" * 5000, " " * 200, "ab" * 2000]


def test_bpe_is_the_librarys():
    codec, library = bpe.ByteBPE(BYTES), Tokenizer.from_file(BYTES)
    for text in fuzz():
        ids = library.encode(text, add_special_tokens=False).ids
        mine = codec.encode(text)
        assert np.frombuffer(mine, "<u4").tolist() == ids, repr(text)
        assert codec.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_bpe_decode_of_broken_bytes():
    codec, library = bpe.ByteBPE(BYTES), Tokenizer.from_file(BYTES)
    ids = library.encode("é世", add_special_tokens=False).ids[:-1]
    assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_word_encoder_and_piece_counter_are_the_librarys():
    mine, library = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    count, pieces = token_counts.PieceCounter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert mine.by_word and count.splits
    for text in fuzz():
        assert np.frombuffer(mine(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert count(text) == len(pieces.encode(text)), repr(text)


def test_caches_stay_bounded():
    count = token_counts.PieceCounter(PIECES)
    count.cache.limit = 10
    for text in fuzz(300):
        assert count(text) == len(count.model.encode(text))
        assert len(count.cache) + len(count.cache.old) <= 21


def test_odd_rows(spark):
    texts = sorted(((i, t or "") for i, t, *_ in odd_rows()), key=repr)
    out = bpe.encode_decode(odd(spark), BYTES).collect()
    assert sorted(((r.doc_id, r.decoded) for r in out), key=repr) == texts
    counted = token_counts.count_tokens(odd(spark), PIECES).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert sorted([(str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted]) == sorted(
        [(str(i), len(t.encode()), len(library.encode(t))) for i, t in texts])
    for f, path in ((bpe.encode_decode, BYTES), (token_counts.count_tokens, PIECES), (packing.pack, WORDS)):
        assert f(empty(spark), path).count() == 0


def test_json_vocabulary_counts(spark):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(odd(spark).where("doc_id < 9"), BYTES).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {
        (i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows() if i and i < 9}


def check_packing(pieces, want, capacity):
    """``want``: per document row the ids; repeated ids are matched as multisets."""
    sequences, rows = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        rows.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    padding = total = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    expected = {}
    for doc, ids in want:
        expected.setdefault((doc, len(ids)), []).append(np.array(ids, "<u4"))
    assert rows.keys() == expected.keys()
    for key, docs in expected.items():
        left = sorted(rows[key])
        assert sum(n for _, n, _ in left) == len(docs) * key[1]
        for start, length, crc in left:
            assert any(zlib.crc32(d[start:start + length].tobytes()) == crc for d in docs)
    return padding, total


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_packing(spark, capacity):
    from pyspark.sql import functions as F
    library = Tokenizer.from_file(WORDS)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in odd_rows()]
    out = packing.pack(odd(spark), WORDS, capacity=capacity).withColumn("ids_crc32", F.crc32("ids")).collect()
    padding, total = check_packing(out, want, capacity)
    assert padding <= 0.15 * total


def test_cuts_waste_little():
    for capacity in (1, 7, 4096):
        for n in range(1, 5000):
            sizes = list(packing.cuts(n, capacity))
            assert sum(sizes) == n and len(sizes) <= n // capacity + 8
            assert all(capacity - size * (capacity // size) < capacity // size for size in sizes)


def test_queries_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    library = Tokenizer.from_file(BYTES)
    for r in queries.op4_bpe(spark, sf).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    words = Tokenizer.from_file(WORDS)
    want = [(i, words.encode(t, add_special_tokens=False).ids + [2]) for i, t in docs.items()]
    padding, total = check_packing(queries.op5_packing(spark, sf).collect(), want, 4096)
    assert padding <= 0.01 * total


def test_words_of_latin_letters_skip_the_whole_encoder(monkeypatch):
    """Words of Latin-1 letters with trailing marks are the library's without a call of its whole pipeline for each."""
    mine, library = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    rng, letters = random.Random(9), "abcxyzßàéñöøÿÀÉÑÖØÞ"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 8))) + rng.choice(["", "", ",", "###", ".$$$"]) for _ in range(3000)]
    words += ["µ", "ª", "×÷", "Ÿ", "İx", "é", "ña,", "ſ", "don't", "é's", "\xad", "É́", "ñ1", "a​é"]
    calls, whole = [], mine._whole
    monkeypatch.setattr(mine, "_whole", lambda text: calls.append(text) or whole(text))
    for word in words:
        assert np.frombuffer(mine(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids, repr(word)
    assert len(calls) < 30
