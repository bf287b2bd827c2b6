from pyspark.sql import functions as F

from agora.functions import text as X


def _titles(spark, titles, extra=None):
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    return [r[0] for r in df.select(X.scope_match(F.col("title"), extra)).collect()]


def test_author_hash(spark):
    df = spark.createDataFrame([("pg",), (None,), ("",)], "by string")
    out = [r[0] for r in df.select(X.author_hash(F.col("by"))).collect()]
    assert len(out[0]) == 64 and out[0] == out[0].lower()
    assert out[1] is None and out[2] is None


def test_scope_prefix_and_keywords(spark):
    assert _titles(spark, ["Ask HN: Should we regulate AI?"]) == [True]
    assert _titles(spark, ["  show hn: my thing"]) == [True]
    assert _titles(spark, ["Local bakery wins best croissant award"]) == [False]
    assert _titles(spark, ["Startup raises money for machine learning"]) == [True]


def test_scope_word_boundary(spark):
    # "ai" must not match inside "raises" or "paint"
    assert _titles(spark, ["He raises paint"]) == [False]
    assert _titles(spark, ["The AI debate"]) == [True]


def test_scope_extra_terms(spark):
    assert _titles(spark, ["FooBaz raises $10M"]) == [False]
    assert _titles(spark, ["FooBaz raises $10M"], ["FooBaz"]) == [True]


def test_cpp_boundary_quirk(spark):
    # \bc\+\+\b needs a word character after the final '+'
    assert _titles(spark, ["i like c++ a lot"]) == [False]
    assert _titles(spark, ["c++x"]) == [True]


def _entities(spark, title, most=None):
    df = spark.createDataFrame([(title,)], "title string")
    return df.select(X.target_entities(F.col("title"), most)).first()[0]


def test_entities_cap_and_order(spark):
    title = ("Intro Alpha Bravo Charlie Delta Echo Foxtrot Golf Hotel India Juliet Kilo")
    out = _entities(spark, title, 10)
    assert len(out) <= 10
    assert out[0] == "Alpha"
    assert _entities(spark, title) == title.split()[1:]


def test_entities_case_insensitive_dedupe(spark):
    out = _entities(spark, "React vs React: the React debate")
    assert [e.lower() for e in out].count("react") == 1


def test_entities_known_and_first_token(spark):
    assert _entities(spark, "OpenAI releases GPT-4 for Developers") == ["OpenAI", "GPT-4", "Developers"]
    # first token is only taken when it is a known entity
    assert _entities(spark, "FooBaz raises FooBaz") == ["FooBaz"]


def test_split_terms(spark):
    df = spark.createDataFrame([(",,,GPT-4,,,",), (None,), (" a , b ",)], "raw string")
    out = [r[0] for r in df.select(X.split_terms(F.col("raw"))).collect()]
    assert out == [["GPT-4"], [], ["a", "b"]]


def _gate(spark, body, terms):
    df = spark.createDataFrame([(body, terms)], "body string, terms array<string>")
    return df.select(X.on_target(F.col("body"), F.col("terms"))).first()[0]


def test_gate(spark):
    assert _gate(spark, "She raised the price.", ["ai"]) is False
    assert _gate(spark, "anything at all", []) is True
    assert _gate(spark, "anything at all", ["  ", ""]) is True
    assert _gate(spark, "Open source licensing is hard", ["open source"]) is True
    assert _gate(spark, "I love GPT-4 a lot", ["GPT-4"]) is True
    assert _gate(spark, "éai x", ["ai"]) is False


def test_blank(spark):
    df = spark.createDataFrame([("   ",), ("",), (None,), ("x",), ("\t\n",)], "b string")
    assert [r[0] for r in df.select(X.is_blank(F.col("b"))).collect()] == [True, True, True, False, True]


def test_author_tag(spark):
    df = spark.createDataFrame([("abcdef0123456789",), (None,)], "h string")
    assert [r[0] for r in df.select(X.author_tag(F.col("h"))).collect()] == ["abcdef01", None]


def test_word_count(spark):
    df = spark.createDataFrame([("  one two   three ",), ("",)], "b string")
    assert [r[0] for r in df.select(X.word_count(F.col("b"))).collect()] == [3, 0]


def test_gate_takes_regex_syntax_literally(spark):
    rows = [("ab\\E.*cd", "\\E.*", True), ("ab xyz cd", "\\E.*", False), ("use c++x now", "c++", True), ("x.y", "x?y", False)]
    for body, term, want in rows:
        df = spark.createDataFrame([(body, [term])], "body string, terms array<string>")
        assert df.select(X.on_target(F.col("body"), F.col("terms"))).first()[0] is want, (body, term)
