"""Caps per post, topic and cycle on a stream, against a loop over the sorted comments."""

import random

import pytest

from agora.streaming import caps as C

SCHEMA = "topic_id long, post_id long, comment_id long, created_utc long"
CYCLE = 1000
DELAY = 5000


def plain(rows, per_post, per_topic, per_cycle, forget=None):
    posts, last, topics, cycles, out = {}, {}, {}, {}, set()
    for topic, post, i, at in sorted(set(rows), key=lambda r: (r[3], r[2])):
        start = at // CYCLE * CYCLE
        p, t, c = (topic, post), topic, (topic, start)
        if forget is not None and p in last and last[p] + forget < start:
            posts[p] = 0
        if posts.get(p, 0) < per_post and topics.get(t, 0) < per_topic and cycles.get(c, 0) < per_cycle:
            posts[p], topics[t], cycles[c] = posts.get(p, 0) + 1, topics.get(t, 0) + 1, cycles.get(c, 0) + 1
            last[p] = at
            out.add((topic, post, i, at, start, posts[p], topics[t], cycles[c]))
    return out


def comments(seed=1, n=160):
    rng = random.Random(seed)
    return [(i % 2, i % 2 * 10 + rng.choice([0, 0, 0, 1, 2, 3]), i, rng.randrange(10 * CYCLE)) for i in range(n)]


def deliver(spark, folder, parts, caps, delay=f"{20 * CYCLE} seconds", runs=1):
    """Files arrive in the order of ``parts``; the stream is started anew ``runs`` times from its checkpoint."""
    closing = [(C.CLOSING_TOPIC, 0, 0, 40 * CYCLE)]
    out, step = None, -(-(len(parts) + 1) // runs)
    every = [*parts, closing]
    for at in range(0, len(every), step):
        for rows in every[at:at + step]:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        out = C.run_cycle_caps(stream, "t", f"{folder}/work", cycle=CYCLE, delay=delay, **caps)
    return {tuple(r) for r in out.collect()}


CAPS = {"per_post": 7, "per_topic": 25, "per_cycle": 5}


@pytest.mark.parametrize("order", ["as they come", "backwards", "mixed"])
def test_any_order_of_files(spark, tmp_path, order):
    rows = comments()
    parts = [rows[i::4] for i in range(4)]
    if order == "backwards":
        parts = parts[::-1]
    elif order == "mixed":
        parts = [sorted(rows, key=lambda r: -r[3])[:50], [], sorted(rows, key=lambda r: -r[3])[50:]]
        parts = [p for p in parts if p]
    want = plain(rows, **CAPS)
    assert deliver(spark, tmp_path, parts, CAPS) == want
    assert max(r[5] for r in want) == 7 and max(r[6] for r in want) == 25 and max(r[7] for r in want) == 5


def test_restart_goes_on(spark, tmp_path):
    """Cycles end while the stream is stopped and started: their counts last."""
    rows = sorted(comments(2), key=lambda r: r[3])
    parts = [rows[:60], rows[60:110], rows[110:]]
    got = deliver(spark, tmp_path, parts, CAPS, delay=f"{CYCLE // 2} seconds", runs=4)
    assert got == plain(rows, **CAPS)


def test_repeated_comments_count_once(spark, tmp_path):
    rows = comments(3, 60)
    assert deliver(spark, tmp_path, [rows, rows[:30]], CAPS) == plain(rows, **CAPS)


def test_counts_are_forgotten(spark, tmp_path):
    caps = {"per_post": 1, "per_topic": 100, "per_cycle": 100}
    rows = [(0, 1, 1, 100), (0, 1, 2, 200), (0, 1, 3, 1500), (0, 1, 4, 5500), (0, 2, 5, 300)]
    got = deliver(spark, tmp_path, [rows], {**caps, "forget": 2 * CYCLE})
    assert got == plain(rows, **caps, forget=2 * CYCLE) and {r[2] for r in got} == {1, 4, 5}


def test_waiting_rows_are_bounded_by_the_posts_cap():
    assert C.merged([(5, 1, 0), (9, 2, 0), (3, 7, 0), (9, 1, 0), (20, 8, 0), (30, 4, 1)], 3) == [
        (3, 7, 0), (5, 1, 0), (9, 2, 0), (30, 4, 1)]
