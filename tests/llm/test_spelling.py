import random
import zlib
from collections import Counter

import pytest
from helpers import empty, odd

from agora.llm import spelling
from agora.llm.spelling import Settings


def plain_words(rows, s):
    """Counts of the words by the definition, letter by letter."""
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}
    n = Counter()
    for doc, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if ch in letters:
                run += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % s.drop_every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                n[run] += 1
            run = ""
    return {w: k for w, k in n.items() if len(w) >= s.least_length and k >= s.least_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, s):
    words = plain_words(rows, s)
    out = {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in words if x != w and is_near(w, x))
        form = near[0][1] if near and -near[0][0] >= s.ratio * n else None
        out[w] = (form, n, len(near), words[form] if form else None)
    result = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result.add((w, form, root, n, k, m))
    return result


def corpus(seed, letters, size, docs=40):
    """Texts whose words are variants of a few stems, some of them very frequent."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices(letters, k=rng.choice([6, 6, 7, 7, 8, 12, 30]))) for _ in range(size)]
    pool = []
    for stem in stems:
        pool += [stem] * rng.choice([1, 2, 30])
        for _ in range(4):
            i = rng.randrange(len(stem))
            pool.append(rng.choice([stem[:i] + stem[i + 1:], stem[:i] + rng.choice(letters) + stem[i:],
                                    stem[:i] + rng.choice(letters) + stem[i + 1:]]))
    return [(d, " ".join(rng.choices(pool, k=250))) for d in range(docs)]


@pytest.mark.parametrize("letters,size,s", [
    ("abcdefghijklmnop", 60, Settings()),
    ("ab", 60, Settings(block=16, part=64)),
    ("aé×ÿb", 40, Settings(drop_every=3, block=32, held=50)),
])
def test_equals_all_pairs(spark, letters, size, s):
    rows = corpus(size, letters, size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in spelling.variants(df, s).collect()}
    want = plain(rows, s)
    assert got == want
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)


def test_odd_rows(spark):
    s = Settings(least_count=1, drop_every=5)
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    out = spelling.variants(odd(spark), s)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in out.collect()} == plain(rows, s)


def test_case_and_long_words(spark):
    rows = [(i, f"ÀBCDEFG àbcdefg {'x' * 5000} {'x' * 4999}y {'x' * 4999} I'm-a_test_words2words") for i in range(6)]
    s = Settings(drop_every=10**9)
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    assert got == plain(rows, s)
    by = {r[0]: r for r in got}
    assert by["Àbcdefg"][4] == 1 and by["x" * 5000][4] == 2


def test_chains_end_at_their_root(spark):
    rows = [(0, " ".join(["planets"] * 200 + ["planet"] * 30 + ["plant s", "plaet " * 5, "planed " * 5]))]
    s = Settings(drop_every=10**9)
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    assert got["planed"] == ("planet", "planets") and got["planet"] == ("planets", "planets")


def test_empty(spark):
    assert spelling.variants(empty(spark)).count() == 0


def test_long_texts_are_read_whole():
    text = "Abcdef1" * 700_000
    assert Counter(spelling.runs(text)) == {"Abcdef": 700_000}
