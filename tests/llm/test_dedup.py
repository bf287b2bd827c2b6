"""Near-duplicates, embedding near-duplicates, repeated byte strings and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
from helpers import empty, odd, odd_rows, prose
from pyspark.sql import functions as F

from agora.llm import exchange, itq, minhash, queries, suffix_dedup
from agora.llm.components import components


def classes(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def slow_near_duplicates(rows, s):
    """Class (smallest id) by id: all pairs, with the operator's weights."""
    words = [minhash.words_of(t or "") for _, t in rows]
    sketch = np.zeros((s.sketch_depth, 1 << s.sketch_bits), np.int64)
    for w in words:
        for k, c in enumerate(minhash.cells(minhash.shingles(w, s.width)[0], s)):
            np.add.at(sketch[k], c, 1)
    weigher = minhash.Weigher(sketch, len(rows), s)
    vectors = [weigher.weights(w) for w in words]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if words[i] == words[j]
             or weigher.similarity(vectors[i], vectors[j]) >= s.threshold]
    label = classes(len(rows), links)
    name = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            name[label[i]] = min(doc, name.get(label[i], doc))
    return {(doc, tuple(words[i])): name.get(label[i]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_are_all_pairs(spark, block):
    rng = random.Random(1)
    rows = [(r[0], r[1]) for r in odd_rows()]
    base = prose(rng, 120).split()
    for k in range(40):  # copies of copies: classes held together by chains
        at = rng.randrange(len(base))
        base = base[:at] + [prose(rng, 1)] + base[at + 1:]
        rows.append((100 + k, " ".join(base)))
    s = minhash.Settings(block=block)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), s=s).collect()
    want = slow_near_duplicates(rows, s)
    got = {(r.doc_id, r.words): r.component_id for r in out}
    assert len(got) == len(out)
    assert got == {(doc, minhash.digest(list(w))): c for (doc, w), c in want.items()}
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in out)


def test_near_duplicates_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    want = slow_near_duplicates(rows, minhash.Settings())
    got = {r.doc_id: r.component_id for r in queries.op6_minhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {doc: c for (doc, _), c in want.items()}


def test_samples_agree_with_the_chance_of_similarity():
    rng = np.random.default_rng(4)
    s = minhash.Settings(bands=100, rows=10)
    weigher = minhash.Weigher(np.zeros((2, 1 << 18), np.int64), 1000, s)
    words = [f"w{i}" for i in range(400)]
    other = words[:300] + [f"v{i}" for i in range(100)]
    rng.shuffle(words[:10])
    real = weigher.similarity(weigher.weights(words), weigher.weights(other))
    agree = (weigher.signature(words) == weigher.signature(other)).mean()
    assert abs(real - agree) < 0.06


def test_representatives_and_empty(spark):
    kept = minhash.representatives(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted((str(r.doc_id) for r in kept.collect()))
    # 2, 13, one row without an id (copies of 1) and 3 (edited) go; 4, 5, 6 are without a word; 13's rows are one
    assert ids == sorted(map(str, [1, 4, 7, 8, 9, 10, 11, 12, 12, 14, None]))
    assert minhash.representatives(empty(spark)).count() == 0
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_representatives_move_texts_once(spark):
    """The choice among rows of one id and text happens where the join with the kept ids put them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = minhash.representatives(odd(spark))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan and "Exchange" not in plan.split("LeftSemi")[0]
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(repr, rows)) == sorted(map(repr, minhash.representatives(odd(spark)).collect()))
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows) and 2 not in {r.doc_id for r in rows}
    assert any(r.doc_id is None for r in rows)


def test_texts_are_dealt_once_for_both_tests(spark, monkeypatch):
    """Texts that share a bucket are written once; the leaders' test and the one across components read them there."""
    made, given = [], []
    meeting, verified = minhash._meeting, minhash.verified
    monkeypatch.setattr(minhash, "_meeting", lambda *a: made.append(meeting(*a)) or made[-1])
    monkeypatch.setattr(minhash, "verified", lambda pairs, documents, *a: given.append(documents) or verified(pairs, documents, *a))
    minhash.near_duplicates(odd(spark)).collect()
    assert len(made) == 1 and given == made
    ids = [r.doc_id for r in made[0].collect()]
    assert len(set(ids)) == len(ids) and {1, 3} <= set(ids) and not {4, 5, 6, 7, 10, 11, 14} & set(ids)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(60)] + [(None, 1), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    label = classes(200, [(a, b) for a, b in edges if a is not None])
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: label[x] for x in touched}


def slow_links(rows, threshold):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and len(v) == 4 and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a in range(len(good)) for b in range(a) if good[a][0] != good[b][0] or True
             if good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= threshold]
    count = [sum(k in x for x in links) for k in range(len(good))]
    label = classes(len(good), links)
    name = {k: min(good[m][0] for m in range(len(good)) if label[m] == label[k]) for k in range(len(good))}
    return {good[k][0]: (count[k], name[k]) for k in range(len(good))}


@pytest.mark.parametrize("block", [4096, 2])
def test_embedding_links_are_all_pairs(spark, block):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i % 5][1]) * (1 + i) + rng.normal(size=4) * 0.05).tolist()) for i in range(25)]
    rows += [(200 + i, rows[3][1]) for i in range(4)]
    odd_ones = [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4),
                (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [1.0, 2.0]), (None, rows[0][1]), (306, [])]
    df = spark.createDataFrame(rows + odd_ones + rows[:2], "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("rep", "v", "t", "key", "block", "links")})
    out = itq.near_duplicates(df, s=itq.Settings(recall=0.999999999, block=block)).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows) + len(odd_ones)
    for i, (n, c) in slow_links(rows, 0.95).items():
        assert got[i] == (n, c, i == c)
    for i, _ in odd_ones:
        assert got[i] == (0, i, True)


def test_embedding_recall_on_the_table(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "embeddings").limit(500)
    near = df.selectExpr("vec_id + 1000 vec_id", "transform(embedding, (x, i) -> cast(x * (1 + 0.2 * sin(vec_id + i)) as float)) embedding")
    both = df.select("vec_id", "embedding").unionByName(near)
    rows = both.collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = ((v @ v.T >= 0.95).sum(1) - 1).sum()
    out = itq.near_duplicates(both).collect()
    assert want > 500 and 0.99 * want <= sum(r.n_links for r in out) <= want
    assert itq.near_duplicates(df.where("false")).count() == 0


def slow_repeats(rows, length):
    """Per row (id, bytes): what is left, and removed runs."""
    first = {}
    for doc, text in rows:
        for at in range(len(text) - length + 1):
            key, place = text[at:at + length], (float("inf") if doc is None else doc, at)
            first[key] = min(first.get(key, place), place)
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if first[text[at:at + length]] < (float("inf") if doc is None else doc, at):
                gone[at:at + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), runs, bytes(b for b, g in zip(text, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,segment", [(1 << 22, 1 << 22), (700, 301)])
def test_repeats_are_the_direct_definitions(spark, chunk, segment):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in odd_rows()]
    pool = [prose(rng, 30) for _ in range(4)]
    for k in range(25):
        rows.append((1000 - 3 * k, "".join(rng.choices([*pool, "é" * 60, "ab" * 70, "z" * 130, prose(rng, 8), "\n"], k=rng.randrange(6)))))
    s = suffix_dedup.Settings(chunk_bytes=chunk, segment=segment)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("chunk", "key", "shard")})
    out = suffix_dedup.remove_repeats(df, s=s).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=repr)
    assert got == slow_repeats([(i, (t or "").encode()) for i, t in rows], 100)
    for r in out:
        assert sum(x.stop - x.start for x in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_repeats_of_the_table(spark):
    rows = [(r.doc_id, r.text.encode()) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    want = {d: (n, k, m, hashlib.sha256(b).hexdigest()) for d, n, k, m, b in slow_repeats(rows, 100)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in queries.op10_suffix_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_without_repeats_keeps_rows_and_columns(spark):
    out = suffix_dedup.without_repeats(odd(spark))
    assert out.columns == odd(spark).columns
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows())
    assert all(r.n_chars == len(r.text) and r.words == "x" for r in rows)
    first = next(r for r in rows if r.doc_id == 1)
    assert first.text == odd_rows()[0][1] and next(r for r in rows if r.doc_id == 2).text == ""
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    for kind in (np.uint8, np.int64, np.uint64):
        for n in (0, 1, 1000):
            v = rng.integers(0, 200, n).astype(kind)
            assert np.array_equal(exchange.unpack(exchange.pack(v), kind), v)
    keys = np.sort(rng.integers(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(4))
    assert np.array_equal(exchange.unpack(exchange.pack(keys, True), np.uint64, True), keys)
    ends = exchange.cuts(keys, 7)
    assert ends[0] == 0 and ends[-1] == len(keys)
    assert all(set(exchange.shard_of(keys[a:b], 7)) <= {i} for i, (a, b) in enumerate(zip(ends, ends[1:])))
