"""Language model, and the pipeline against a brute-force version."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from helpers import empty, odd, odd_rows
from pyspark.sql import functions as F

import corpus_pipeline
from agora.llm import minhash, packing, pitman_yor, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORDS.findall((text or "").encode().lower()), None]


def slow_scores(rows, s):
    """The same model with dictionaries: base figures, and the averaged predictive probabilities."""
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [tokens(t) for _, t in rows]
    c, cc, start = Counter(), Counter(), "start"
    for t, h in zip(texts, held):
        if not h:
            c.update(t)
            cc.update(zip([start, *t], t))
    customers = Counter()
    for (u, _), k in cc.items():
        customers[u] += k
    n, v = sum(c.values()), len(c)
    key = {w: pitman_yor.mix(np.array([pitman_yor.END if w is None else pitman_yor.START if w == start
                                       else pitman_yor.xxhash.xxh64_intdigest(w)], np.uint64))
           for w in {None, start, *(w for t in texts for w in t)}}
    tables = {p: 1 for p in cc}
    total = {}
    of_context = {u: k ** s.discount for u, k in customers.items()}
    root = {w: (c[w] + 1) / (n + sum(not h for h in held) + v + any(not h for h in held) + 1) for w in key}
    for sweep in range(1, s.sweeps + 1):
        tables = {(u, w): int(pitman_yor.draw_tables(
            np.array([k]), np.array([max(of_context[u] - tables[u, w], 0.0)]), np.array([root[w]]),
            pitman_yor.uniform(pitman_yor.bigram_keys(key[u], key[w], s.bigram_bits), sweep),
            s.strength, s.discount, s.exact)[0]) for (u, w), k in cc.items()}
        of_context, of_word = Counter(), Counter()
        for (u, w), k in tables.items():
            of_context[u] += k
            of_word[w] += k
        own = {w: int(pitman_yor.root_tables(np.array([of_word[w]]), key[w], sweep, s)[0]) for w in key}
        new = (s.root_strength + s.root_discount * sum(own.values())) / (v + 1)
        root = {w: (of_word[w] - s.root_discount * own[w] + new) / (s.root_strength + sum(of_word.values())) for w in key}
        if sweep > s.burn_in:
            for u, w in {pair for t in texts for pair in zip([start, *t], t)}:
                total[u, w, sweep] = ((cc[u, w] - s.discount * tables.get((u, w), 0)
                                       + (s.strength + s.discount * of_context[u]) * root[w]) / (s.strength + customers[u]))
    p = lambda u, w: sum(total[u, w, k] for k in range(s.burn_in + 1, s.sweeps + 1)) / (s.sweeps - s.burn_in)
    return sorted([(str(i), h, len(t), sum(c[w] > 0 for w in t), n,
                    round(sum(math.log10((c[w] + 1) / ((n + 1) * (v + 1))) for w in t), 6),
                    round(sum(math.log10(p(u, w)) for u, w in zip([start, *t], t)), 6))
                   for (i, _), h, t in zip(rows, held, texts)])


def fast_scores(df, s):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in pitman_yor.score(df, s=s).collect())


def test_scores_are_the_slow_models(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for chunk in (1 << 23, 900):
        s = pitman_yor.Settings(chunk_bytes=chunk, exact=16)
        assert fast_scores(odd(spark), s) == slow_scores(rows, s)


def test_base_score_of_the_query(spark, tmp_path):
    """c + 1 over N + 1 * (V + 1): the chances of the training types and of one unseen add up to 1."""
    odd(spark).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(i, tokens(t)) for i, t, *_ in odd_rows()]
    c = Counter(w for i, t in texts if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    assert abs(sum((k + 1) / (n + 1 * (v + 1)) for k in [*c.values(), 0]) - 1) < 1e-9
    want = [(str(i), len(t), sum(c[w] > 0 for w in t), n,
             round(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in t), 6)) for i, t in texts]
    got = queries.op7_pitman_yor(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)


def test_model_beats_the_base_on_held_out_texts(spark):
    out = [r for r in queries.op7_pitman_yor(spark, SF).collect() if r.held_out]
    assert len(out) > 15
    assert sum(r.score for r in out) / sum(r.n_tokens for r in out) > -3.6


def test_probabilities_sum_to_one():
    """Over the training types and one unseen word, in a context and at the root."""
    s = pitman_yor.Settings()
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 30, 50)
    tables = pitman_yor.draw_tables(counts, np.full(50, 60), np.full(50, 0.02), rng.random(50), s.strength, s.discount, s.exact)
    assert ((tables >= np.minimum(counts, 1)) & (tables <= counts)).all()
    root = np.full(50, 1 / 50)
    p = (counts - s.discount * tables + (s.strength + s.discount * tables.sum()) * root) / (s.strength + counts.sum())
    assert abs(p.sum() - 1) < 1e-9


def test_table_draws_follow_the_conditional():
    """Against one seating of customers after another, weighted: exact by enumeration for five customers."""
    d, theta, others, base, n = 0.6, 1.5, 4, 0.1, 5
    weight = {(1,): 1.0}
    for _ in range(n - 1):
        after = {}
        for sizes, w in weight.items():
            for k, size in enumerate(sizes):
                key = tuple(sorted((*sizes[:k], size + 1, *sizes[k + 1:])))
                after[key] = after.get(key, 0) + w * (size - d)
            key = tuple(sorted((*sizes, 1)))
            after[key] = after.get(key, 0) + w * (theta + d * (others + len(sizes))) * base
        weight = after
    want = np.zeros(n + 1)
    for sizes, w in weight.items():
        want[len(sizes)] += w
    want /= want.sum()
    u = (np.arange(100_000) + 0.5) / 100_000
    got = pitman_yor.draw_tables(np.full(len(u), n), np.full(len(u), others), np.full(len(u), base), u, theta, d, 16)
    assert np.abs(np.bincount(got, minlength=n + 1) / len(u) - want).max() < 1e-4


def test_empty_and_untrained(spark):
    assert pitman_yor.score(empty(spark)).count() == 0
    held = odd(spark).where("doc_id = 12")
    assert zlib.crc32(b"12") % 7 != 2
    out = pitman_yor.score(held, mod=1, rest=0).collect()
    assert len(out) == 2 and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in out)


def test_pipeline_is_its_stages_one_by_one(spark):
    """Every stage's decisions, recomputed from its own input without its row-keeping form."""
    docs = queries.table(spark, SF, "documents")
    labels = queries.table(spark, SF, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    frames, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).checkpoint()
        assert now.columns == docs.columns
        frames[name] = now
    weights = quality_classifier.fit(docs, labels, ~queries.held_out_label())
    scored = quality_classifier.score(docs, weights).where(F.col("score") >= 0.3)
    assert ids(frames["quality_classifier"]) == ids(scored)
    assert ids(frames["quality_rules"]) == ids(quality_rules.judge(frames["quality_classifier"]).where("kept"))
    assert ids(frames["minhash"]) == ids(minhash.near_duplicates(frames["quality_rules"]).where("kept"))
    rows = [(r.doc_id, r.text.encode()) for r in frames["minhash"].collect()]
    from test_dedup import slow_repeats
    want = {d: b.decode("utf-8", "ignore") for d, _, _, _, b in slow_repeats(rows, 100)}
    assert {r.doc_id: r.text for r in frames["suffix_dedup"].collect()} == want
    got = corpus_pipeline.run(spark, SF).collect()
    encode = packing.encoder(queries.public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
    assert {d: sum(p.length for p in ps) for d, ps in pieces.items()} == {d: len(encode(t)) // 4 + 1 for d, t in want.items()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    long_enough = {r.doc_id for r in quality_rules.judge(docs).where("not base_failed").collect()}
    assert good & long_enough <= set(ids(frames["quality_rules"]))


def test_pipeline_on_odd_rows(spark, tmp_path):
    odd(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (14, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in odd_rows()}
