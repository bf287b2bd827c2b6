import pytest
from pyspark.sql import functions as F

from agora.llm import url_filter as U
from agora.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string"


def plain(url):
    """host and path by string functions."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in rest[:cut]), path


def plain_rule(host, path):
    hits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(hits, key=lambda r: len(r.text), default=None)


def plain_bounds(outcomes, s):
    """host -> lower bound of the bad share, with dictionaries. ``outcomes``: (host, domain, suffix, bad or None)."""
    def size(rows):
        top = low = 0.0
        for mu, bad, n in rows:
            if n > 1 and 0 < mu < 1:
                top += (bad - n * mu) ** 2 / (mu * (1 - mu)) - n
                low += n * (n - 1)
        return min(max(1 / max(top / low, 1 / (s.most + 1)) - 1, s.least), s.most) if low else s.least
    tables = []
    for level in (2, 1, 0):
        table = {}
        for row in outcomes:
            x = table.setdefault(row[level], [0, 0, row[min(level + 1, 2)]])
            if row[3] is not None:
                x[0] += row[3]
                x[1] += 1
        tables.append(table)
    bad, n = sum(x[0] for x in tables[0].values()), sum(x[1] for x in tables[0].values())
    mean = {k: (bad + 0.5) / (n + 1) for k in tables[0]}
    for number, table in enumerate(tables):
        mu = {k: mean[k if number == 0 else x[2]] for k, x in table.items()}
        m = size([(mu[k], x[0], x[1]) for k, x in table.items()])
        ab = {k: (x[0] + m * mu[k], x[1] - x[0] + m * (1 - mu[k])) for k, x in table.items()}
        mean = {k: a / (a + b) for k, (a, b) in ab.items()}
    return {k: a / (a + b) - s.z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 for k, (a, b) in ab.items()}


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "https://a.example.org/", "https://a.example.org/es/1",
        "https://example.org/es/", "https://notexample.org/es/9", "https://x.example.org/en/1", "https://x.example.org/en/12?x",
        "https://shop.com/fr/1#a", "https://shop.com/de/7", "https://shop.com/de?x=1", "https://shop.com?/de/", "ftp://b.net://c/d",
        "https://user@h.co.uk:80/p", "http://10.0.0.1/x", "http://Ünï.com/fr/é", "http://a.com/de/" + "x" * 20000] + [
        f"https://bad.com/de/{i}" for i in range(30)] + [f"https://good.com/fr/{i}" for i in range(30)] + [
        "https://bad.com/en/1", "https://good.com/en/1", "https://bad.com/en/1"]


@pytest.fixture
def judged(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, "https://bad.com/es/", "x"), (3, "https://bad.com/en/1", None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("host", "bad", "n", "share", "domain")])
    return rows, U.judge(df, URL_RULES).collect()


def test_parsing_and_rules(judged):
    rows, got = judged
    want = []
    for i, url, _ in rows:
        host, path = plain(url)
        rule = plain_rule(host, path)
        want.append((i, host, path, rule.text if rule else None))
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(want, key=key)
    told = {r.text: r.verdict for r in URL_RULES}
    assert all(r.verdict == told[r.rule] for r in got if r.rule)


def test_reputation_equals_dictionaries(judged, spark):
    rows, got = judged
    names = {h: (d, x) for h, d, x in spark.createDataFrame([(plain(u)[0],) for _, u, _ in rows], "host string").distinct().select(
        "host", U.domain_of(F.col("host")), U.suffix_of(F.col("host"))).collect()}
    outcomes = []
    for _, url, _ in rows:
        host, path = plain(url)
        rule = plain_rule(host, path)
        outcomes.append((host, *names[host], None if rule is None else rule.verdict == "block"))
    bounds = plain_bounds(outcomes, U.Settings())
    for r in got:
        assert r.bound == pytest.approx(bounds[r.host], abs=1e-9)
        if r.rule is None:
            assert r.verdict == ("block" if bounds[r.host] > 0.5 else "allow")
    assert {r.verdict for r in got if r.host == "bad.com" and r.path.startswith("/e")} == {"block"}
    assert {r.verdict for r in got if r.host == "good.com" and r.path.startswith("/e")} == {"allow"}


def test_domains(spark):
    want = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"),
            "a.x.co.uk:80": ("x.co.uk", "co.uk"), "me@a.org": ("a.org", "org"), "localhost": ("localhost", "localhost"),
            "10.0.0.1": ("10.0.0.1", "1"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    got = df.select("host", U.domain_of(F.col("host")).alias("d"), U.suffix_of(F.col("host")).alias("x")).collect()
    assert {r.host: (r.d, r.x) for r in got} == want


def test_shuffled_reputations_equal_broadcast_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], SCHEMA)
    few = sorted(U.judge(df, URL_RULES).collect())
    monkeypatch.setattr(U, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(U, "HOT_SHARE", 0.2)
    many = sorted(U.judge(df, URL_RULES).collect())
    assert [tuple(r)[:5] for r in many] == [tuple(r)[:5] for r in few]
    assert [r.bound for r in many] == pytest.approx([r.bound for r in few], abs=1e-12)


def test_outcomes_of_ones_own(spark):
    df = spark.createDataFrame([(i, "http://a.b.net/", str(i % 10)) for i in range(200)], SCHEMA)
    got = U.judge(df, [], outcome=F.col("html") != "0").collect()
    assert {r.verdict for r in got} == {"block"} and {r.rule for r in got} == {None}


def test_empty(spark):
    out = U.judge(spark.createDataFrame([], SCHEMA), URL_RULES)
    assert out.count() == 0 and out.columns == ["page_id", "host", "path", "rule", "verdict", "bound"]


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://a.com/", None)], SCHEMA)
    plan = U.judge(df, URL_RULES)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "InArrow", "InPandas"))
