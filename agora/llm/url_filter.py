"""URL filtering by rules and empirical-Bayes host reputation, in DataFrame functions only.

Rules. A rule is a host with a path prefix and a verdict. It fits its host and
all subdomains of it where the url's path starts with its prefix; the longest
rule that fits decides (of equally long ones, that of the longer host).

Reputation. Pages with a labelled outcome (by default those a rule decides,
"block" being the bad one) are counted per host. The bad share of a host is
beta-distributed around its registered domain's, that around its suffix's,
and that around the share of all pages. How tightly (the prior's size in
pages) comes from the data, level by level, by the method of moments: the
spread of the counts beyond the binomial one. Large counts speak for
themselves; small ones are shrunk towards what is above them. A page without
a rule is blocked where the lower posterior bound of its host's bad share
(mean less ``z`` standard deviations) is above ``limit``.

Counts are partial sums, so a host with a third of the pages costs one row a
task. Reputations come back to the pages by a broadcast if they are few
(counted); beyond that those of hot hosts are broadcast, of which there are at
most ``1 / HOT_SHARE``, and the others joined by a shuffle.

A null url, or one without "://", has an empty host and path; its reputation
is that of the empty host. An empty prefix of a host, ports and user names
stay in ``host`` as they are written; domains and suffixes leave them out.
Rows with a null or repeated page id are judged like any other. An empty table
gives no rows; with no labelled page the share of all pages is one half.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import BROADCAST_ROWS
from agora.session import ensure_checkpoint_dir

#: Second-level labels under which registrations are made in country domains (fixed values).
SECOND_LEVEL = "co|com|org|net|gov|edu|ac"
#: A key with more than this share of the rows is hot; there are at most 1 / HOT_SHARE.
HOT_SHARE = 1e-4


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    limit: float = 0.5      # bad share above which a host is blocked
    z: float = 1.645        # standard deviations below the mean of the bound
    least: float = 1.0      # smallest and largest size of a prior, in pages
    most: float = 1000.0


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(at > 0, lower), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The part under which domains are registered: the last label, or two as in co.uk."""
    name = F.regexp_extract(host, "([^@:]*)(:[0-9]*)?$", 1)
    two = F.regexp_extract(name, rf"[^.]\.((?:{SECOND_LEVEL})\.[a-z][a-z])$", 1)
    return F.when(two != "", two).otherwise(F.regexp_extract(name, "([^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; an address or a single label is its own domain."""
    name = F.regexp_extract(host, "([^@:]*)(:[0-9]*)?$", 1)
    three = F.regexp_extract(name, rf"([^.]+\.(?:{SECOND_LEVEL})\.[a-z][a-z])$", 1)
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    return (F.when(name.rlike("^[0-9.]*$"), name).when(three != "", three)
            .when(two != "", two).otherwise(name))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the rule that decides, null if none fits. ``rules`` is a short list, not a table."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        hit = fits(rule, host, path)
        text = F.when(hit, rule.text).otherwise(text)
        verdict = F.when(hit, rule.verdict).otherwise(verdict)
    return text, verdict


def _attached(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per ``key``, with ``n_rows``, how many of ``rows`` have it)."""
    size, total = facts.agg(F.count(F.lit(1)), F.sum("n_rows")).first()  # two numbers
    told = facts.drop("n_rows")
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(told), key, "left")
    hot = facts.where(F.col("n_rows") > total * HOT_SHARE).drop("n_rows")
    usual = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(told, key, "left")
    return rows.join(F.broadcast(hot), key).unionByName(usual)


def _prior_size(level: DataFrame, s: Settings) -> float:
    """Size of the beta prior around ``mu`` from the spread of counts (``bad`` of ``n``) beyond the binomial one."""
    spread = F.col("mu") * (1 - F.col("mu"))
    excess = F.pow(F.col("bad") - F.col("n") * F.col("mu"), F.lit(2)) / spread - F.col("n")
    found = level.where((F.col("n") > 1) & (spread > 0)).agg(
        F.sum(excess), F.sum(F.col("n") * (F.col("n") - 1.0))).first()  # two numbers
    if not found[1]:
        return s.least
    rho = max(found[0] / found[1], 1 / (s.most + 1))
    return min(max(1 / rho - 1, s.least), s.most)


def _level(table: DataFrame, s: Settings) -> DataFrame:
    """``table`` with the posterior's parameters ``a`` and ``b`` and its mean ``share``, given prior means ``mu``."""
    m = F.lit(_prior_size(table, s))
    a = F.col("bad") + m * F.col("mu")
    b = F.col("n") - F.col("bad") + m * (1 - F.col("mu"))
    return table.select("*", a.alias("a"), b.alias("b")).withColumn("share", F.col("a") / (F.col("a") + F.col("b")))


def host_reputation(outcomes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, n_rows, bad, n, share, bound) of every host of ``outcomes`` (host, bad boolean; null: not labelled)."""
    ensure_checkpoint_dir(outcomes.sparkSession)
    host = F.col("host")
    hosts = (outcomes.groupBy("host")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.count("bad").alias("n"), F.count_if("bad").alias("bad"))
             .select("*", domain_of(host).alias("domain"), suffix_of(host).alias("suffix")).checkpoint())
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n_rows")]
    domains = hosts.groupBy("domain", "suffix").agg(*counts).checkpoint()
    suffixes = domains.groupBy("suffix").agg(*counts)
    bad, n = hosts.agg(F.sum("bad"), F.sum("n")).first()  # two numbers
    top = _level(suffixes.withColumn("mu", F.lit(((bad or 0) + 0.5) / ((n or 0) + 1.0))), s)
    middle = _level(_attached(domains, top.select("suffix", "n_rows", F.col("share").alias("mu")), "suffix"), s)
    bottom = _level(_attached(hosts, middle.select("domain", "n_rows", F.col("share").alias("mu")), "domain"), s)
    a, b = F.col("a"), F.col("b")
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return bottom.select("host", "n_rows", "bad", "n", "share", (F.col("share") - s.z * spread).alias("bound"))


def judge(pages: DataFrame, rules: list[Rule], s: Settings = Settings(), id_col: str = "page_id",
          url_col: str = "url", outcome: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) of every page.

    ``outcome``: boolean column, whether a page turned out bad, null where it
    is not known; by default a rule's verdict tells.
    """
    url = F.col(url_col).cast("string")
    named = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                         *([] if outcome is None else [outcome.alias("bad")]))
    text, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = named.select("*", text.alias("rule"), verdict.alias("told"))
    if outcome is None:
        ruled = ruled.withColumn("bad", F.col("told") == "block")
    facts = host_reputation(ruled.select("host", "bad"), s).select("host", "n_rows", "bound")
    method = F.when(F.col("bound") > s.limit, "block").otherwise("allow")
    return _attached(ruled, facts, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("told", method).alias("verdict"), "bound")
