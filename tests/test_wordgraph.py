"""Packed blocks of the words' graph against the same rounds word by word."""

import random

from agora.operators import polarity, wordgraph


def rounds_by_word(edges, seeds, rounds):
    words = {w for w, _, _ in edges} | set(seeds)
    score = {w: seeds.get(w, 0.0) for w in words}
    for _ in range(rounds):
        score = {w: seeds[w] if w in seeds else
                 sum(x * score.get(v, 0.0) for u, v, x in edges if u == w) / sum(x for u, _, x in edges if u == w) for w in words}
    return score


def test_blocks_of_any_size_give_the_same_rounds(spark, monkeypatch):
    """Edges one way only, words without edges of their own, and a word that meets all others."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    edges = {(u, v): rng.random() + 0.1 for u in words[:30] for v in rng.sample(words, 4)}
    edges |= {("w0", v): 1.0 for v in words} | {(v, "w0"): 0.5 for v in words[:30]}
    rows = [(u, v, x) for (u, v), x in edges.items()]
    seeds = {"w1": 1.0, "w2": -1.0, "w35": 1.0, "absent": -1.0}
    want = rounds_by_word(rows, seeds, 6)
    frame = spark.createDataFrame(rows, "word string, neighbour string, weight double")
    known = spark.createDataFrame(list(seeds.items()), "word string, seed double")
    for block in (1 << 18, 20, 3):
        monkeypatch.setattr(wordgraph, "SPREAD_BLOCK", block)
        monkeypatch.setattr(wordgraph, "BLOCK", max(block, 8))
        monkeypatch.setattr(wordgraph, "SLICE", block)
        got = dict(polarity.propagate(frame, known, rounds=6).collect())
        assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-12 for w in want)


def test_a_round_sends_packed_scores_not_rows_of_words(spark):
    """What a round sends: a row per pair of blocks, whatever the number of words (before: a row per word and task)."""
    n = 3000
    rows = [(f"w{i}", f"w{(i * 7 + k) % n}", 1.0) for i in range(n) for k in range(3)]
    graph = wordgraph.Graph(spark.createDataFrame(rows, "word string, neighbour string, weight double"),
                            polarity.seed_scores(spark, ["w1"], ["w2"]))
    state = graph.advance(None, 2)
    assert graph.count == 1 and state.count() == 1
    assert graph.scores(state).count() == n
    assert graph.blocks.where(f"kind = {wordgraph.SEND}").count() == graph.count ** 2
    graph.release()
