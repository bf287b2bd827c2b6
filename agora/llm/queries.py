"""The registered queries of the training-data operators, and SQL for those it can express.

Each query applies its operator to its whole table with production parameters
and derives the digest columns from the operator's real output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import (
    bpe,
    html_extract,
    itq,
    minhash,
    packing,
    pitman_yor,
    quality_classifier,
    quality_rules,
    rtree,
    spelling,
    suffix_dedup,
    token_counts,
    url_filter,
)
from agora.llm.common import crc_mod

SEQUENCE = 4096
LEAST_SCORE = 0.3


def held_out_label() -> Column:
    """Whether a document's label is held out from fitting."""
    return crc_mod(F.col("doc_id"), 5) == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "distance2")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on labelled rows with crc32(doc_id) mod 5 other than 0, scored on every row."""
    documents = table(spark, sf_dir, "documents")
    weights = quality_classifier.fit(documents, table(spark, sf_dir, "labels"), ~held_out_label())
    out = quality_classifier.score(documents, weights)
    return out.select("doc_id", held_out_label().alias("held_out"), "score",
                      (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def packed(documents: DataFrame) -> DataFrame:
    out = packing.pack(documents, public_tokenizers.path("word_bpe_49k.json"), capacity=SEQUENCE)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "component_id", "kept")


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > SEQUENCE)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Rules of the url filter: (host, path prefix, verdict).
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


_URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(h, d, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hits AS (
  SELECT host, path, arg_max(h || d, length(h || d)) AS rule, arg_max(v, length(h || d)) AS told
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, d)
  GROUP BY host, path),
r AS (SELECT p.*, rule, told FROM p LEFT JOIN hits USING (host, path)),
hosts AS (
  SELECT host, count(told) AS n, count(*) FILTER (WHERE told = 'block') AS bad,
         regexp_extract(host, '([^@:]*)(:[0-9]*)?$', 1) AS name
  FROM r GROUP BY host),
named AS (
  SELECT *,
    CASE WHEN regexp_matches(name, '^[0-9.]*$') THEN name
         WHEN regexp_matches(name, '[^.]+\.(co|com|org|net|gov|edu|ac)\.[a-z][a-z]$')
           THEN regexp_extract(name, '[^.]+\.[^.]+\.[a-z][a-z]$')
         WHEN regexp_matches(name, '[^.]+\.[^.]+$') THEN regexp_extract(name, '[^.]+\.[^.]+$') ELSE name END AS domain,
    CASE WHEN regexp_matches(name, '[^.]\.(co|com|org|net|gov|edu|ac)\.[a-z][a-z]$')
           THEN regexp_extract(name, '[a-z]+\.[a-z][a-z]$') ELSE regexp_extract(name, '[^.]*$') END AS suffix
  FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM hosts) AS mu
             FROM domains GROUP BY suffix),
s1 AS (SELECT least(greatest(coalesce(1 / greatest(sum((bad - n * mu) ** 2 / (mu * (1 - mu)) - n) / sum(n * (n - 1.0)),
         1 / 1001.0) - 1, 1), 1), 1000) AS m FROM suffixes WHERE n > 1 AND mu > 0 AND mu < 1),
suffix_share AS (SELECT suffix, (bad + m * mu) / (n + m) AS mu FROM suffixes, s1),
dm AS (SELECT domains.*, mu FROM domains JOIN suffix_share USING (suffix)),
s2 AS (SELECT least(greatest(coalesce(1 / greatest(sum((bad - n * mu) ** 2 / (mu * (1 - mu)) - n) / sum(n * (n - 1.0)),
         1 / 1001.0) - 1, 1), 1), 1000) AS m FROM dm WHERE n > 1 AND mu > 0 AND mu < 1),
domain_share AS (SELECT domain, (bad + m * mu) / (n + m) AS mu FROM dm, s2),
hm AS (SELECT host, n, bad, mu FROM named JOIN domain_share USING (domain)),
s3 AS (SELECT least(greatest(coalesce(1 / greatest(sum((bad - n * mu) ** 2 / (mu * (1 - mu)) - n) / sum(n * (n - 1.0)),
         1 / 1001.0) - 1, 1), 1), 1000) AS m FROM hm WHERE n > 1 AND mu > 0 AND mu < 1),
beta AS (SELECT host, bad + m * mu AS a, n - bad + m * (1 - mu) AS b FROM hm, s3),
bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM beta)
SELECT page_id, host, path, rule,
  coalesce(told, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN bound USING (host)"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def mining_rows(embeddings: DataFrame) -> DataFrame:
    """Rows that take part, with the label to go by and the vector as integers."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.where(F.col("label").isNotNull() & x.isNotNull() & finite).select(
        "vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("vector"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.mine(mining_rows(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


_NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3"""


QUERIES = {f.__name__: f for f in (
    op1_html_extract, op2_quality_rules, op3_quality_classifier, op4_bpe, op5_packing, op6_minhash,
    op7_pitman_yor, op8_embedding_dedup, op9_token_counts, op10_suffix_dedup, op11_url_filter,
    op12_spelling_variants, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op11_url_filter": _URL_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
