"""Catalogue: clustering, representatives, quotes and cluster reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from agora.functions.scalar import round6
from agora import lexicon
from agora.operators import cluster as CL
from agora.plans.registry import query
from agora.sources import tables as T
from agora.sources import versioned as V
from agora.sources.tables import with_views
from agora.streaming import streams as S

_SEEDS_SQL = """
pts AS (SELECT topic_id, stance, comment_id, CAST(embedding AS DOUBLE[]) AS vec FROM v_vector),
sizes AS (SELECT topic_id, stance, count(*) AS n FROM pts GROUP BY ALL),
dv AS (SELECT topic_id, stance, vec, min(comment_id) AS first_id FROM pts GROUP BY ALL),
rk AS (SELECT dv.*, n, row_number() OVER (PARTITION BY topic_id, stance ORDER BY first_id) - 1 AS cluster
       FROM dv JOIN sizes USING (topic_id, stance) WHERE n >= 2),
seeds AS (SELECT topic_id, stance, CAST(cluster AS INTEGER) AS cluster, vec FROM rk
          WHERE cluster < least(10, n)),
asg AS (SELECT p.topic_id, p.stance, p.comment_id, p.vec,
          min({'d': list_sum(list_transform(range(1, len(p.vec) + 1),
                   lambda i: (p.vec[i] - s.vec[i]) * (p.vec[i] - s.vec[i]))), 'c': s.cluster}).c AS cluster
        FROM pts p JOIN seeds s USING (topic_id, stance) GROUP BY ALL),
upd AS (SELECT topic_id, stance, cluster, count(*) AS size FROM asg GROUP BY ALL),
dims AS (SELECT topic_id, stance, cluster, i, avg(v) AS m FROM (
          SELECT topic_id, stance, cluster, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM asg)
        GROUP BY ALL),
cents AS (SELECT topic_id, stance, cluster, list(m ORDER BY i) AS vec FROM dims GROUP BY ALL)"""


def _points(spark, sf):
    return CL.prepare(T.v_vector(spark, sf))


def _step(spark, sf):
    pts = _points(spark, sf)
    seeds = CL.seed_centroids(pts)
    assigned = CL.assign(pts, seeds)
    return pts, seeds, assigned


@query("cluster_assign_step", "M6 (one assignment from fixed seeds)", with_views(f"""
WITH {_SEEDS_SQL}
SELECT topic_id, stance, comment_id, cluster FROM asg""", ["v_vector"]))
def cluster_assign_step(spark, sf):
    _, _, a = _step(spark, sf)
    return a.select("topic_id", "stance", "comment_id", "cluster")


@query("cluster_update_step", "M6 (one centroid update)", with_views(f"""
WITH {_SEEDS_SQL}
SELECT c.topic_id, c.stance, c.cluster, CAST(u.size AS BIGINT) AS size,
  list_transform(c.vec, lambda x: round(x, 6)) AS centroid
FROM cents c JOIN upd u USING (topic_id, stance, cluster)""", ["v_vector"]))
def cluster_update_step(spark, sf):
    _, _, a = _step(spark, sf)
    u = CL.update(a)
    return u.select("topic_id", "stance", "cluster", "size",
                    F.transform("vec", lambda x: F.round(x, 6)).alias("centroid"))


@query("cluster_kmeans", "M6 M9 A10 A23 M10")
def cluster_kmeans(spark, sf):
    """Converged grouped k-means, then the minimum-size gate (rows-only;
    invariants are checked in tests)."""
    clusters, _ = CL.kmeans(T.v_vector(spark, sf), k=10, max_iter=20)
    return CL.size_gate(clusters).select("topic_id", "stance", "cluster", "size")


@query("representative", "M7 W3", with_views(f"""
WITH {_SEEDS_SQL},
m AS (SELECT a.topic_id, a.stance, a.cluster, a.comment_id, a.vec, c.vec AS cvec
      FROM asg a JOIN cents c USING (topic_id, stance, cluster)
      JOIN v_comment b USING (comment_id) WHERE length(b.body) >= 40),
s AS (SELECT topic_id, stance, cluster, comment_id,
        list_dot_product(vec, cvec) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(cvec, cvec))) AS sim
      FROM m WHERE list_dot_product(vec, vec) > 0 AND list_dot_product(cvec, cvec) > 0)
SELECT topic_id, stance, cluster, arg_min(comment_id, [-sim, comment_id]) AS representative_id,
       round(max(sim), 6) AS similarity
FROM s GROUP BY ALL""", ["v_vector", "v_comment"]))
def representative(spark, sf):
    _, _, a = _step(spark, sf)
    cents = CL.update(a)
    r = CL.representative(a, cents, T.v_comment(spark, sf))
    return r.withColumn("similarity", round6(F.col("similarity")))


_QUOTES_SQL = """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, comment_id) AS cand_rank
           FROM v_comment),
k AS (SELECT * FROM c WHERE {cut} AND length(coalesce(body, '')) >= 40),
u AS (SELECT *, row_number() OVER (PARTITION BY topic_id, {same} ORDER BY cand_rank) AS p FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY cand_rank) AS quote_rank FROM u WHERE p = 1)
SELECT topic_id, comment_id, score, author_hash, CAST(quote_rank AS INTEGER) AS quote_rank
FROM q WHERE quote_rank <= 3"""


def _quotes(spark, sf, **cuts):
    q = CL.top_quotes(T.v_comment(spark, sf), ["topic_id"], **cuts)
    return q.select("topic_id", "comment_id", "score", "author_hash", F.col("quote_rank").cast("int"))


@query("top_quotes", "J9 W2 U5 Q4, 10 candidates", with_views(
    _QUOTES_SQL.format(cut="cand_rank <= 10", same="substr(body, 1, 100)"), ["v_comment"]))
def top_quotes(spark, sf):
    return _quotes(spark, sf, n_candidates=lexicon.QUOTE_CANDIDATES, prefix=lexicon.DEDUP_PREFIX_LEN)


@query("top_quotes_all", "J9 W2 U5", with_views(_QUOTES_SQL.format(cut="true", same="body"), ["v_comment"]))
def top_quotes_all(spark, sf):
    return _quotes(spark, sf)


@query("cluster_report", "J8 A6 K5 P15 Q13")
def cluster_report(spark, sf):
    clusters, assigned = CL.kmeans(T.v_vector(spark, sf), k=10, max_iter=10)
    gated = CL.size_gate(clusters)
    reps = CL.representative(assigned.join(CL.prepare(T.v_vector(spark, sf)).select(
        "comment_id", "vec"), "comment_id"), clusters, T.v_comment(spark, sf))
    return CL.cluster_report(gated, reps, T.v_comment(spark, sf), stance="SUPPORT")


@query("cluster_size_by_stance", "A7 A23", with_views(f"""
WITH {_SEEDS_SQL},
st AS (SELECT * FROM (VALUES ('SUPPORT', 0), ('OPPOSE', 1), ('MIXED', 2), ('NEUTRAL', 3)) v(stance, stance_order)),
cm AS (SELECT stance, count(*) AS comments FROM asg GROUP BY stance),
cl AS (SELECT stance, count(*) AS clusters FROM upd GROUP BY stance)
SELECT stance, CAST(stance_order AS INTEGER) AS stance_order,
  CAST(coalesce(comments, 0) AS BIGINT) AS comments, CAST(coalesce(clusters, 0) AS BIGINT) AS clusters
FROM st LEFT JOIN cm USING (stance) LEFT JOIN cl USING (stance) ORDER BY stance_order""",
                                                      ["v_vector"]))
def cluster_size_by_stance(spark, sf):
    _, _, a = _step(spark, sf)
    return CL.size_by_stance(a, CL.update(a))


@query("cluster_sentiment_toxicity", "E3", with_views(f"""
WITH {_SEEDS_SQL}
SELECT a.topic_id, a.stance, a.cluster, count(*) AS n, round(avg(k.toxicity), 6) AS avg_toxicity,
  round(avg(CASE WHEN k.sentiment = 'POSITIVE' THEN 1 WHEN k.sentiment = 'NEGATIVE' THEN -1 ELSE 0 END), 6)
    AS avg_sentiment
FROM asg a JOIN v_comment_class k USING (comment_id) GROUP BY ALL""",
                                                           ["v_vector", "v_comment_class"]))
def cluster_sentiment_toxicity(spark, sf):
    _, _, a = _step(spark, sf)
    r = CL.sentiment_toxicity(a, T.v_comment_class(spark, sf))
    return r.select("topic_id", "stance", "cluster", "n", round6(F.col("avg_toxicity"))
                    .alias("avg_toxicity"), round6(F.col("avg_sentiment")).alias("avg_sentiment"))


@query("relevance_sort", "E6 K3", with_views("""
WITH pts AS (SELECT topic_id, stance, comment_id, CAST(embedding AS DOUBLE[]) AS vec FROM v_vector),
q AS (SELECT topic_id, stance, arg_min(vec, comment_id) AS qvec FROM pts GROUP BY ALL),
s AS (SELECT p.topic_id, p.stance, p.comment_id,
        coalesce(list_dot_product(vec, qvec) / nullif(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qvec, qvec)), 0), 0.0) AS sim
      FROM pts p JOIN q USING (topic_id, stance)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, stance ORDER BY sim DESC, comment_id) AS rank FROM s)
SELECT topic_id, stance, comment_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
                                            ["v_vector"]))
def relevance_sort(spark, sf):
    v = T.v_vector(spark, sf)
    pts = CL.prepare(v)
    q = pts.groupBy(*CL.BUCKET).agg(F.min_by("vec", "comment_id").alias("qvec"))
    r = CL.relevance_top(v, q, 5)
    return r.select(*CL.BUCKET, "comment_id", round6(F.col("sim")).alias("sim"),
                    F.col("rank").cast("int"))


@query("cluster_job", "M10 J3 M6 M9 M7 M8 W2")
def cluster_job(spark, sf):
    """The whole clustering job over every (topic, stance) bucket: vectors of
    classified comments, k-means, size gate, representative and keywords."""
    v = T.v_vector(spark, sf)
    cls = v.select("comment_id", "stance")
    comments = T.v_comment(spark, sf).select("comment_id", "body", "score").join(
        v.select("comment_id", "topic_id"), "comment_id")
    out = CL.cluster_job(comments, cls, v.select("comment_id", "embedding"), max_iter=10)
    return out["clusters"].select("topic_id", "stance", "cluster", "size", "keywords",
                                  "representative_id")


@query("clusters_replaced", "S10 Q12, clusters and assignments in one commit", with_views(f"""
WITH {_SEEDS_SQL}
SELECT topic_id, comment_id, CASE WHEN topic_id = 2 OR stance = 'SUPPORT' THEN stance END AS stance,
  CASE WHEN topic_id = 2 OR stance = 'SUPPORT' THEN cluster END AS cluster,
  CASE WHEN topic_id = 2 OR stance = 'SUPPORT' THEN CAST(size AS BIGINT) END AS size
FROM asg JOIN upd USING (topic_id, stance, cluster)""", ["v_vector"]))
def clusters_replaced(spark, sf):
    """A second run over two of the three topics finds clusters of one stance only: the other stances' clusters go,
    and their members are in none."""
    work = S._workdir(spark, "clusters")
    pts = CL.prepare(T.v_vector(spark, sf))
    assigned = CL.assign(pts, CL.seed_centroids(pts)).select("topic_id", "comment_id", "stance", "cluster")
    clusters = assigned.groupBy("topic_id", "stance", "cluster").agg(F.count(F.lit(1)).alias("size"))
    tables = V.Tables(spark, f"{work}/store", {"clusters": clusters.schema, "assignments": assigned.schema},
                      {"clusters": ["topic_id"], "assignments": ["topic_id"]}, buckets=16)
    topics = assigned.select("topic_id")
    V.replace_clusters(tables, 0, topics, clusters, assigned)
    support = F.col("stance") == "SUPPORT"
    V.replace_clusters(tables, 1, topics.where(F.col("topic_id") < 2), clusters.where(support), assigned.where(support))
    return tables.read("assignments").join(tables.read("clusters"), ["topic_id", "stance", "cluster"], "left").select(
        "topic_id", "comment_id", "stance", "cluster", "size")
