"""The gate against Python's own regular expressions."""

import io
import random
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from agora.functions import text as X


def slow(body, terms):
    terms = [t.strip().lower() for t in terms if t.strip()]
    text = (body or "").lower()

    def hit(t):
        return t in text if " " in t else re.search(rf"\b{re.escape(t)}\b", text) is not None
    return not terms or any(hit(t) for t in terms)


def test_gate_equals_word_boundaries(spark):
    rng = random.Random(7)
    parts = ["c", "++", "C", "node", ".js", ".", "net", " ", " ", "\n", "é", "ai", "_", "-", "gpt", "4", "日本", "+"]
    terms = ["c++", ".net", "node.js", "AI", "gpt-4", "c", "++", "net c", "é", "日本", "_ai", "-", "4", "js.", "node.js-4"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 9))), rng.sample(terms, rng.randint(1, 3)))
            for i in range(4000)]
    rows += [(-1, None, ["ai"]), (-2, "x", None), (-3, "x", ["", " "]), (-4, "c++x", ["c++"]), (-5, "c++", ["c++"])]
    df = spark.createDataFrame(rows, "i long, body string, terms array<string>")
    got = {r[0]: r[1] for r in df.select("i", X.on_target(F.col("body"), F.col("terms"))).collect()}
    wrong = [(b, t, got[i]) for i, b, t in rows if got[i] != slow(b, t or [])]
    assert not wrong, wrong[:5]
    assert got[-4] and not got[-5]
    assert {True, False} <= set(got.values())


def test_no_regex_is_built_from_a_column(spark):
    df = spark.createDataFrame([("a", ["b"])], "body string, terms array<string>")
    out = io.StringIO()
    with redirect_stdout(out):
        df.select(X.on_target(F.col("body"), F.col("terms")).alias("hit")).explain("extended")
    plan = out.getvalue().split("== Physical Plan ==")[1]
    assert "Exchange" not in plan
    assert plan.count("RLIKE(") == 0 or "concat(" not in plan
    assert "\\Q" not in plan


def test_terms_by_broadcast_or_salted_join(spark):
    from agora.operators.common import with_target_terms
    posts = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "post_id long, target_terms string")
    rows = [(i, (1, 2, 4, None)[i % 4]) for i in range(40)] + [(7, 1), (7, 1)]
    comments = spark.createDataFrame(rows, "comment_id long, post_id long")
    want = sorted((i, p or 0, {1: "a"}.get(p, "")) for i, p in rows)
    for limit in (10, 2):
        got = with_target_terms(comments, posts, limit=limit).select("comment_id", "post_id", "target_terms").collect()
        assert sorted((i, p or 0, t or "") for i, p, t in got) == want
