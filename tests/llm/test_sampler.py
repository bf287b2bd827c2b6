"""The language model's sampler: draws of many customers, and the root given its own tables."""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import test_model
from helpers import odd, odd_rows

from agora.llm import pitman_yor

U = (np.arange(20_000) + 0.5) / 20_000


@lru_cache(maxsize=2)
def log_stirling(c, discount):
    """The recurrence of the seatings' weights, a customer at a time, in logarithms."""
    t = np.arange(c + 1)
    log_s = np.full(c + 1, -np.inf)
    log_s[1] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(1, c):
            stay = log_s + np.log(np.maximum(n - discount * t, 0.0))
            log_s = np.logaddexp(stay, np.concatenate([[-np.inf], log_s[:-1]]))
    return log_s


def conditional(c, others, base, strength, discount):
    """Chances of 0 to c tables."""
    log_s = log_stirling(c, discount).copy()
    log_s[1:] += np.cumsum(np.log((strength + discount * (others + np.arange(c))) * base))
    p = np.exp(log_s - log_s.max())
    return p / p.sum()


@pytest.mark.parametrize("discount", [0.75, 0.8])
@pytest.mark.parametrize("c", [17, 40, 64, 65, 100, 400, 3000, 5000])
def test_draws_of_many_customers_follow_the_conditional(c, discount):
    for others, base in ((0, 0.3), (20, 0.01), (500, 0.001), (300, 0.02), (300, 0.06), (900, 0.05), (20_000, 0.02)):
        want = conditional(c, others, base, 1.0, discount)
        got = pitman_yor.draw_tables(np.full(len(U), c), np.full(len(U), others), np.full(len(U), base), U, 1.0, discount, 64)
        t = np.arange(c + 1)
        mean = want @ t
        deviation = np.sqrt(want @ (t - mean) ** 2)
        share = np.bincount(got, minlength=c + 1) / len(U)
        assert abs(got.mean() - mean) <= 0.1 * deviation + 0.01, (others, base, mean, got.mean())
        assert abs(got.std() - deviation) <= 0.1 * deviation + 0.01, (others, base, deviation, got.std())
        assert np.abs(np.cumsum(share - want)).max() < (2e-3 if c <= 64 else 0.06), (others, base)


def test_draws_of_very_many_customers():
    """Within a normal error of the limits: with few others, one table and a Poisson number more."""
    c = np.full(len(U), 10 ** 9)
    got = pitman_yor.draw_tables(c, np.full(len(U), 3000), np.full(len(U), 1e-3), U, 1.0, 0.75, 64)
    mean = (3000 + 1 / 0.75) / 1000
    assert abs(got.mean() - 1 - mean) < 0.02 and abs(got.var() - mean) < 0.05
    got = pitman_yor.draw_tables(c, np.full(len(U), 10 ** 6), np.full(len(U), 1e-3), U, 1.0, 0.75, 64)
    assert abs(got.mean() - 1000) < 5 and abs(got.std() - 1000 ** 0.5) < 2


def test_two_sweeps_are_averaged_after_one_burnt_in():
    s = pitman_yor.Settings()
    assert s.burn_in >= 1 and s.sweeps - s.burn_in >= 2 and s.exact >= 64


def test_root_is_drawn_given_its_other_tables(spark, monkeypatch):
    """Scores are those of the dictionary model when its root draws are given the sweep's other root tables."""
    rows = [(r[0], r[1]) for r in odd_rows()]
    s = pitman_yor.Settings(root_given=True)
    plain, state = pitman_yor.root_tables, {}
    held = {i for i, _ in rows if pitman_yor.is_held_out(i, 7, 2)}
    types = len({w for i, t in rows if i not in held for w in test_model.tokens(t)})

    def given(customers, words, sweep, settings):
        now = state.setdefault(sweep, {})
        before = state.get(sweep - 1)
        total = sum(before.values()) if before else types
        key, c = int(words[0]), int(customers[0])
        own = before[key] if before else min(c, 1)
        now[key] = int(plain(customers, words, sweep, settings, (np.array([total - own]), types))[0])
        return np.array([now[key]])
    with monkeypatch.context() as patch:
        patch.setattr(pitman_yor, "root_tables", given)
        want = test_model.slow_scores(rows, s)
    for chunk in (1 << 23, 900):
        assert test_model.fast_scores(odd(spark), pitman_yor.Settings(root_given=True, chunk_bytes=chunk)) == want
    assert want != test_model.slow_scores(rows, pitman_yor.Settings())


def test_texts_are_parsed_once_and_answers_stay_in_place(spark):
    """One pass over the texts builds the chunks; every exchange by chunk and every shard's answers are made once."""
    out = pitman_yor.score(odd(spark), s=pitman_yor.Settings(root_given=True, chunk_bytes=900))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = [x for x in plan.split("\n") if "Exchange" in x and "Reused" not in x]
    sweeps = pitman_yor.Settings().sweeps
    assert sum("hashpartitioning(chunk" in x for x in lines) == 2 + sweeps  # the chunks, the counts, each sweep's answers
    assert sum("hashpartitioning(shard" in x for x in lines) == 1 + sweeps


def test_words_are_those_of_the_pattern():
    texts = ["", " \t", "A b\x0bC\x0c\x1c d\r\n", "É\xa0x\x85y z", "\x00 a ", " lead", "the  two", None]
    coded, sizes = pitman_yor.words_of(pa.array(texts, pa.string()))
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert [w.encode() for w in coded.to_pylist()] == [w for ws in want for w in ws]
    assert sizes.tolist() == [len(ws) for ws in want]


def test_draws_without_logarithms_are_those_with():
    rng = np.random.default_rng(5)
    n = 20_000
    c, others, base, u = rng.integers(17, 4096, n), rng.integers(0, 5000, n).astype(float), rng.random(n) * 1e-3, rng.random(n)
    args = (c, others, base, u, 1.0, 0.75, 64)
    few, plain = pitman_yor._window(*args, True), pitman_yor._window(*args)
    assert (few == plain).all() and few.max() > 5
