"""Per-(topic, stance) clustering and cluster reports (M6, M7, M9, M10,
W2, W3, J3, J8, J9, A6, A7, A10, A23, E3, E6, E7).

The converged job (``kmeans``) runs on blocks of points with sampled seeds and
bounds per point (``operators.kmeans``). One step in plain expressions
(``assign``, ``update``) joins each point with its bucket's centroids, packed
into one row (fan-out 1, never all pairs), and averages by Spark ML's
Summarizer (a partial aggregate). The k lowest-id distinct vectors or a greedy
farthest-first traversal can stand in for the sampled seeds.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora import lexicon
from agora.operators import kmeans as KM
from agora.session import ensure_checkpoint_dir

BUCKET = ["topic_id", "stance"]


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def prepare(points: DataFrame) -> DataFrame:
    """(topic_id, stance, comment_id, embedding) with vectors as double arrays."""
    return points.select(*BUCKET, "comment_id",
                         F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def seed_centroids(points: DataFrame, k: int = lexicon.N_CLUSTERS_PER_STANCE) -> DataFrame:
    """k = min(k, n) seeds per bucket: the lowest-id distinct vectors.

    Buckets with fewer than 2 points get none (M6 skips them)."""
    sizes = points.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))
    distinct = points.groupBy(*BUCKET, "vec").agg(F.min("comment_id").alias("first_id"))
    w = Window.partitionBy(*BUCKET).orderBy("first_id")
    # a literal rank limit: Spark keeps k rows per bucket and task before the shuffle
    ranked = (distinct.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
              .withColumn("cluster", F.col("_rank") - 1).drop("_rank"))
    return (ranked.join(sizes.where(F.col("n") >= 2), BUCKET)
            .where(F.col("cluster") < F.least(F.lit(k), F.col("n")))
            .select(*BUCKET, F.col("cluster").cast("int"), "vec"))


def _small_parts(df: DataFrame) -> int:
    """Partition count for per-bucket tables (one row per bucket/cluster):
    the cluster's default parallelism, not the shuffle partition count."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def farthest_first_seeds(points: DataFrame, k: int = lexicon.N_CLUSTERS_PER_STANCE) -> DataFrame:
    """Deterministic spread-out seeds: per bucket, the lowest-id point, then
    repeatedly the point farthest from every seed chosen so far (ties by
    id), up to min(k, n) seeds; duplicates of a seed are never chosen.

    The greedy counterpart of k-means++ seeding, run for all buckets at
    once: each round is one join of the points with their bucket's newest
    seed and one max_by aggregate (partial, skew-safe), k rounds in total.
    """
    sizes = points.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    pts = points.join(sizes, BUCKET, "left_semi").select(*BUCKET, "comment_id", "vec")
    first = pts.groupBy(*BUCKET).agg(F.min_by(F.struct("comment_id", "vec"), "comment_id").alias("s"))
    seeds = [first.select(*BUCKET, F.lit(0).alias("cluster"), F.col("s.vec").alias("vec"))]
    mind = (pts.join(first.select(*BUCKET, F.col("s.vec").alias("svec")), BUCKET)
            .select(*BUCKET, "comment_id", "vec", sq_dist(F.col("vec"), F.col("svec")).alias("d")))
    mind = mind.persist(StorageLevel.MEMORY_AND_DISK)
    cached = [mind]
    for j in range(1, k):
        nxt = (mind.where(F.col("d") > 0).join(sizes.where(F.col("n") > j), BUCKET, "left_semi")
               .groupBy(*BUCKET)
               .agg(F.max_by(F.col("vec"), F.struct(F.col("d"), -F.col("comment_id"))).alias("nvec")))
        # one row per bucket; checkpointed so the next round's plan refers to
        # ``mind`` once (otherwise the plan doubles every round)
        nxt = nxt.coalesce(_small_parts(nxt)).checkpoint(eager=True)
        seeds.append(nxt.select(*BUCKET, F.lit(j).alias("cluster"), F.col("nvec").alias("vec")))
        new = (mind.join(nxt, BUCKET, "left")
               .select(*BUCKET, "comment_id", "vec",
                       F.when(F.col("nvec").isNull(), F.col("d"))
                       .otherwise(F.least(F.col("d"), sq_dist(F.col("vec"), F.col("nvec")))).alias("d"))
               .persist(StorageLevel.MEMORY_AND_DISK))
        cached.append(new)
        mind = new
    for df in cached:  # the seeds only depend on the checkpointed rounds
        df.unpersist()
    out = seeds[0]
    for sd in seeds[1:]:
        out = out.unionByName(sd)
    return out.select(*BUCKET, F.col("cluster").cast("int"), "vec")


def _packed(centroids: DataFrame) -> DataFrame:
    """One row per bucket with its (<= k) centroids as an array."""
    return centroids.groupBy(*BUCKET).agg(
        F.collect_list(F.struct("cluster", "vec")).alias("cents"))


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid per point (squared Euclidean; ties -> lower cluster)."""
    j = points.join(_packed(centroids), BUCKET)
    best = F.array_min(F.transform("cents", lambda c: F.struct(
        sq_dist(F.col("vec"), c["vec"]).alias("d"), c["cluster"].alias("cluster"))))
    return j.select(*BUCKET, "comment_id", "vec", best["cluster"].alias("cluster"),
                    best["d"].alias("dist"))


def update(assigned: DataFrame) -> DataFrame:
    """Mean vector and size per (bucket, cluster); empty clusters vanish."""
    agg = assigned.groupBy(*BUCKET, "cluster").agg(
        Summarizer.mean(array_to_vector(F.col("vec"))).alias("mean"),
        F.count(F.lit(1)).alias("size"))
    return agg.select(*BUCKET, "cluster", vector_to_array("mean").alias("vec"), "size")


def kmeans(points: DataFrame, k: int = lexicon.N_CLUSTERS_PER_STANCE, max_iter: int = 20,
           tol: float = 1e-9, normalize: bool = False,
           seeding: str = "sampled") -> tuple[DataFrame, DataFrame]:
    """M6: grouped Lloyd iterations until no centroid moves more than tol.

    Returns (centroids with size, assignments), both read from stored
    assignments. ``normalize`` scales every vector to unit length first (E7,
    cosine-style k-means). ``seeding``: "sampled" (k-means||), "farthest" or
    "lowest" (ids). Steps, bounds and edge cases: see ``operators.kmeans``.
    """
    ensure_checkpoint_dir(points.sparkSession)
    pts = KM.usable(prepare(points))
    if normalize:
        pts = pts.withColumn("vec", F.transform("vec", lambda x: F.coalesce(
            F.try_divide(x, norm(F.col("vec"))), F.lit(0.0))))
    packed = KM.blocks(pts)
    if seeding == "sampled":
        seeds = KM.sampled_seeds(packed, k)
    else:
        seeds = {"farthest": farthest_first_seeds, "lowest": seed_centroids}[seeding](pts, k)
    clusters, assigned, _ = KM.lloyd(packed, seeds, max_iter, tol)
    assigned = KM.stored(assigned)
    packed.unpersist()
    return clusters, assigned


def size_gate(clusters: DataFrame, min_size: int = lexicon.MIN_CLUSTER_SIZE) -> DataFrame:
    """M9: drop clusters smaller than min_size (members become unassigned)."""
    return clusters.where(F.col("size") >= min_size)


def representative(assigned: DataFrame, centroids: DataFrame, comments: DataFrame,
                   min_len: int = lexicon.MIN_QUOTE_LENGTH) -> DataFrame:
    """Per cluster, the member with the highest cosine similarity to
    the centroid among bodies of at least ``min_len`` chars; ties -> lowest
    id; zero vectors skipped; zero centroid -> no representative."""
    m = (assigned.join(comments.select("comment_id", "body"), "comment_id")
         .where(F.length("body") >= min_len))
    c = centroids.select(*BUCKET, "cluster", F.col("vec").alias("cvec"))
    j = m.join(c, BUCKET + ["cluster"])
    vn, cn = norm(F.col("vec")), norm(F.col("cvec"))
    sim = dot(F.col("vec"), F.col("cvec")) / (vn * cn)
    ok = j.where((vn > 0) & (cn > 0)).select(*BUCKET, "cluster", "comment_id", sim.alias("sim"))
    best = ok.groupBy(*BUCKET, "cluster").agg(
        F.min_by(F.struct("comment_id", "sim"), F.struct(-F.col("sim"), F.col("comment_id")))
        .alias("b"))
    return best.select(*BUCKET, "cluster", F.col("b.comment_id").alias("representative_id"),
                       F.col("b.sim").alias("similarity"))


def top_quotes(members: DataFrame, cluster_keys: list[str], n_candidates: int | None = None,
               min_len: int = lexicon.MIN_QUOTE_LENGTH, prefix: int | None = None,
               n: int = lexicon.TOP_QUOTES) -> DataFrame:
    """W2/J9/U5 (Q4: in code order): the ``n_candidates`` best by score (ties by
    id; None: all) -> body length >= min_len -> drop a repeated body, or a
    repeated ``prefix`` of that many characters -> first n.

    The first cut is a ranked filter (per-partition top-k before the
    shuffle); without it the best row per body is one aggregate."""
    w = Window.partitionBy(*cluster_keys).orderBy(F.desc("score"), F.asc("comment_id"))
    cands = members
    if n_candidates is not None:
        cands = cands.withColumn("cand_rank", F.row_number().over(w)).where(F.col("cand_rank") <= n_candidates)
    cands = cands.where(F.length(F.coalesce("body", F.lit(""))) >= min_len)
    same = F.sha2("body", 256) if prefix is None else F.substring("body", 1, prefix)
    rows = cands.withColumn("_same", same)
    uniq = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*cluster_keys, "_same").orderBy(
        F.desc("score"), F.asc("comment_id")))).where(F.col("_p") == 1).drop("_p", "_same")
    if n_candidates is None:
        uniq = uniq.withColumn("cand_rank", F.row_number().over(w)).where(F.col("cand_rank") <= n)
    wq = Window.partitionBy(*cluster_keys).orderBy("cand_rank")
    return (uniq.withColumn("quote_rank", F.row_number().over(wq)).where(F.col("quote_rank") <= n))


def cluster_report(clusters: DataFrame, reps: DataFrame, comments: DataFrame,
                   stance: str | None = None) -> DataFrame:
    """Clusters (optionally one stance) by size with the
    representative comment joined in one pass (no per-cluster lookups)."""
    c = clusters if stance is None else clusters.where(F.col("stance") == stance)
    r = reps.join(comments.select(F.col("comment_id").alias("representative_id"),
                                  F.col("body").alias("representative_body")),
                  "representative_id", "left")
    out = c.join(r, BUCKET + ["cluster"], "left")
    total = c.select(F.sum("size")).scalar()
    return out.select(*BUCKET, "cluster", "size", "representative_id", "representative_body",
                      total.alias("total_comments")).orderBy(F.desc("size"), *BUCKET, "cluster")


def size_by_stance(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Comments and clusters per stance, zero-filled, fixed order."""
    comments = assigned.groupBy("stance").agg(F.count(F.lit(1)).alias("comments"))
    n_clusters = clusters.groupBy("stance").agg(F.count(F.lit(1)).alias("clusters"))
    spark = assigned.sparkSession
    labels = spark.range(len(lexicon.STANCES)).select(
        F.element_at(F.array(*[F.lit(s) for s in lexicon.STANCES]),
                     (F.col("id") + 1).cast("int")).alias("stance"),
        F.col("id").cast("int").alias("stance_order"))
    return (labels.join(comments, "stance", "left").join(n_clusters, "stance", "left")
            .select("stance", "stance_order",
                    F.coalesce("comments", F.lit(0)).cast("bigint").alias("comments"),
                    F.coalesce("clusters", F.lit(0)).cast("bigint").alias("clusters"))
            .orderBy("stance_order"))


SENTIMENT_VALUE = {"POSITIVE": 1, "NEUTRAL": 0, "NEGATIVE": -1}


def sentiment_toxicity(assigned: DataFrame, classifications: DataFrame) -> DataFrame:
    """Per cluster mean toxicity and mean sentiment (-1 / 0 / 1)."""
    s = F.when(F.col("sentiment") == "POSITIVE", 1).when(F.col("sentiment") == "NEGATIVE", -1) \
        .otherwise(0)
    j = assigned.join(classifications.select("comment_id", "sentiment", "toxicity"), "comment_id")
    return j.groupBy(*BUCKET, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("toxicity").alias("avg_toxicity"),
        F.avg(s).alias("avg_sentiment"))


def relevance_top(points: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """Per bucket, the n comments most similar (cosine) to the bucket's
    query vector; ties by id. ``queries`` has one (bucket, qvec) row per
    bucket, so the join adds one column per point."""
    j = prepare(points).join(queries, BUCKET)
    sim = F.coalesce(F.try_divide(dot(F.col("vec"), F.col("qvec")),
                                  norm(F.col("vec")) * norm(F.col("qvec"))), F.lit(0.0))
    w = Window.partitionBy(*BUCKET).orderBy(F.desc("sim"), "comment_id")
    return (j.select(*BUCKET, "comment_id", sim.alias("sim"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def cluster_input(comments: DataFrame, classifications: DataFrame, vectors: DataFrame) -> DataFrame:
    """Comments x classification x embedding, for all topics at once."""
    return (comments.select("comment_id", "topic_id")
            .join(classifications.select("comment_id", "stance"), "comment_id")
            .join(vectors.select("comment_id", "embedding"), "comment_id")
            .where(F.col("embedding").isNotNull()))


def replace_clusters(old: DataFrame, new: DataFrame, processed_topics: DataFrame) -> DataFrame:
    """Every processed topic's clusters are fully replaced (Q12: a
    stance that now has no cluster loses its old ones too); other topics'
    clusters are kept. Anti join + union, not a partition overwrite."""
    kept = old.join(processed_topics.select("topic_id"), "topic_id", "left_anti")
    return kept.unionByName(new)


def cluster_job(comments: DataFrame, classifications: DataFrame, vectors: DataFrame,
                k: int = lexicon.N_CLUSTERS_PER_STANCE, max_iter: int = 20,
                min_size: int = lexicon.MIN_CLUSTER_SIZE) -> dict[str, DataFrame]:
    """J3 -> M6 -> M9 -> M7 / M8 / W2 for every (topic, stance).

    Returns clusters (with representative and keywords), assignments (NULL
    cluster for members of removed clusters) and top quotes."""
    from agora.operators.keywords import keywords
    pts = cluster_input(comments, classifications, vectors)
    clusters, assigned = kmeans(pts, k=k, max_iter=max_iter)
    kept = size_gate(clusters, min_size)
    key = BUCKET + ["cluster"]
    members = assigned.join(kept.select(*key), key, "left_semi")
    reps = representative(members.join(prepare(pts).select("comment_id", "vec"), "comment_id"),
                          kept, comments)
    docs = members.join(comments.select("comment_id", F.col("body").alias("text")), "comment_id") \
        .select(F.concat_ws("/", F.col("topic_id").cast("string"), "stance",
                            F.col("cluster").cast("string")).alias("ckey"),
                F.col("comment_id").alias("doc_id"), "text")
    kw = (keywords(docs, "ckey").groupBy("ckey")
          .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))),
                                        lambda x: x["term"]), ",").alias("keywords")))
    ckey = F.concat_ws("/", F.col("topic_id").cast("string"), "stance", F.col("cluster").cast("string"))
    out = (kept.withColumn("ckey", ckey).join(kw, "ckey", "left").drop("ckey")
           .join(reps.select(*key, "representative_id"), key, "left"))
    assignments = assigned.join(kept.select(*key, F.lit(True).alias("_k")), key, "left") \
        .select(*BUCKET, "comment_id",
                F.when(F.col("_k"), F.col("cluster")).alias("cluster"))
    quotes = top_quotes(members.join(comments.select("comment_id", "body", "score"), "comment_id"), key)
    return {"clusters": out, "assignments": assignments, "quotes": quotes}
