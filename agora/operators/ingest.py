"""Ingestion over item dumps: candidates, reply trees, caps, dedup and
keyed upserts (S2-S8, P2, P6-P12, U1, U4, J13, J14, W1, W5, W7, A8, A11).

A live forum API is replaced by item tables (``spark.read.json`` of dumps or
any DataFrame with the item columns). Tree expansion is a
series of equi-joins against the whole item table, one per level, so all
stories are expanded in the same job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora import lexicon
from agora.functions.text import author_hash, is_blank, permalink, scope_match
from agora.operators.common import first_per_key, last_per_key, prior_running_sum
from agora.session import ensure_checkpoint_dir

# Raw item schema of a forum dump (every field but id may be missing).
ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("by", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("time", T.LongType()),
    T.StructField("descendants", T.IntegerType()),
    T.StructField("kids", T.ArrayType(T.LongType())),
    T.StructField("parent", T.LongType()),
    T.StructField("deleted", T.BooleanType()),
    T.StructField("dead", T.BooleanType()),
])

_PATH_WIDTH = 19
# Positions of a ranked list stay below this, so (type, position) is one number.
ORDER_STRIDE = 1 << 40


def read_items(spark, path: str) -> DataFrame:
    """Item dump (JSON lines) with the declared schema, no inference."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def live_items(items: DataFrame) -> DataFrame:
    """Drop deleted / dead items."""
    return items.where(~F.coalesce(F.col("deleted"), F.lit(False))
                       & ~F.coalesce(F.col("dead"), F.lit(False)))


def ranked_lists(lists: DataFrame) -> DataFrame:
    """(story_type, ids array) -> (story_type, pos, item_id)."""
    return lists.select("story_type", F.posexplode("ids").alias("pos", "item_id"))


def story_candidates(ranked: DataFrame, types=lexicon.STORY_TYPES,
                     per_type: int | None = None) -> DataFrame:
    """Ids of each enabled type, the first ``per_type`` of each if
    given; an id in several lists is kept once, at its first (type order,
    position). ``order_key`` is that order as one number."""
    rank = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("story_type")) - 1
    cut = ranked.where(F.col("story_type").isin(*types)).withColumn("type_rank", rank.cast("int"))
    if per_type is not None:
        cut = cut.where(F.col("pos") < per_type)
    first = first_per_key(cut, ["item_id"], [F.col("type_rank"), F.col("pos")])
    return first.withColumn(
        "order_key", (F.col("type_rank").cast("bigint") * ORDER_STRIDE + F.col("pos")))


def story_filter(stories: DataFrame, min_comments: int = lexicon.MIN_COMMENTS_THRESHOLD,
                 extra_terms=None) -> DataFrame:
    """Activity gate and scope predicate."""
    return stories.where((F.coalesce("descendants", F.lit(0)) >= min_comments)
                         & scope_match(F.col("title"), extra_terms))


def expand_threads(roots: DataFrame, items: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Reply trees of the given stories, down to ``max_depth`` levels if given.

    ``roots`` has (story_id, root_item_id); ``items`` has (id, parent, type).
    Level d+1 = comments whose parent is in level d. Children of missing or
    non-comment items are not visited; children of blank comments are
    (Q16). ``path`` is the zero-padded id chain, so ordering by it gives
    pre-order with siblings in id order. Every level is checkpointed once, so
    neither the next level nor the union computes it again; without a depth the
    expansion ends with the first empty level. An item that is its own ancestor is
    not visited a second time, so a cycle of parents ends too.
    """
    ensure_checkpoint_dir(items.sparkSession)
    kids = items.select("id", "parent", "type")
    step = F.lpad(F.col("id").cast("string"), _PATH_WIDTH, "0")
    parents = roots.select(F.col("root_item_id").alias("parent"), "story_id", F.col("root_item_id").alias("root"),
                           F.lit("").alias("ppath"))
    levels = []
    while max_depth is None or len(levels) < max_depth:
        path = step if not levels else F.concat_ws("/", "ppath", step)
        new = (F.col("id") != F.col("root")) & ~F.contains("ppath", step)
        level = (kids.join(parents, "parent").where(new)
                 .select("story_id", "id", "parent", "type", F.lit(len(levels)).alias("depth"), path.alias("path"),
                         "root").checkpoint())
        levels.append(level.drop("root"))
        if max_depth is None and level.isEmpty():
            break
        parents = level.where(F.col("type") == "comment").select(
            F.col("id").alias("parent"), "story_id", "root", F.col("path").alias("ppath"))
    if not levels:
        return kids.join(parents, "parent").select(
            "story_id", "id", "parent", "type", F.lit(0).alias("depth"), step.alias("path")).where(F.lit(False))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def cap_comments(expanded: DataFrame, story_order: DataFrame, per_post: int | None = None,
                 per_topic: int | None = None, per_cycle: int | None = None) -> DataFrame:
    """Strict volume caps in pre-order (Q8: strict, not soft); off unless given.

    Per story (post = topic here) keep the first min(per_post, per_topic)
    comments by path - a ranked filter that Spark plans as a per-partition
    top-k before the shuffle. The cycle cap is then a running total over
    the stories in story order, computed blockwise (no global window over
    comments). Only rows that will be stored should be passed in: blank and
    non-comment items use no slots (see ``storable``). Without any cap the
    rows come back as they are, with their rank only if a cap asks for it.
    """
    caps = [c for c in (per_post, per_topic) if c is not None]
    if not caps and per_cycle is None:
        return expanded
    ranked = expanded.withColumn(
        "rn", F.row_number().over(Window.partitionBy("story_id").orderBy("path")))
    if caps:
        ranked = ranked.where(F.col("rn") <= min(caps))
    if per_cycle is None:
        return ranked
    counts = ranked.groupBy("story_id").agg(F.count(F.lit(1)).alias("kept"))
    counts = counts.join(story_order.select("story_id", "order_key"), "story_id")
    prior = prior_running_sum(counts, "order_key", "kept", "prior")
    allowed = prior.select("story_id", F.greatest(F.lit(0), F.least(
        F.col("kept"), F.lit(per_cycle) - F.col("prior"))).alias("allowed"))
    return (ranked.join(allowed, "story_id")
            .where(F.col("rn") <= F.col("allowed")).drop("allowed"))


def storable(expanded: DataFrame, items: DataFrame) -> DataFrame:
    """Expanded items that become comments: of type comment, with a body."""
    ok = items.where((F.col("type") == "comment") & ~is_blank(F.col("text"))).select("id")
    return expanded.join(ok, "id", "left_semi")


def ingest_counts(requested: DataFrame, items: DataFrame, stored: DataFrame) -> DataFrame:
    """One row - stories_fetched, stories_ingested, comments_added,
    comments_skipped and cap_reached.

    ``requested`` (story_id, item_id) lists every comment id the trees ask
    for; an id without a live, non-blank comment behind it is skipped; what is
    neither skipped nor stored was cut by a cap. One pass: the three facts of a
    requested id are joined by id and counted together.
    """
    live = live_items(items) if "deleted" in items.columns else items
    good = (live.where((F.col("type") == "comment") & ~is_blank(F.col("text")))
            .select(F.col("id").alias("item_id"), F.lit(True).alias("good")))
    kept = stored.select(F.col("id").alias("item_id"), F.lit(True).alias("kept"))
    marked = requested.join(good, "item_id", "left").join(kept, "item_id", "left")
    return marked.agg(
        F.countDistinct("story_id").alias("stories_fetched"),
        F.countDistinct(F.when(F.col("kept"), F.col("story_id"))).alias("stories_ingested"),
        F.count_if(F.col("kept")).alias("comments_added"),
        F.count_if(F.col("good").isNull()).alias("comments_skipped"),
        (F.count_if(F.col("good") & F.col("kept").isNull()) > 0).alias("cap_reached"))


def to_comments(items: DataFrame, expanded: DataFrame, platform: str = lexicon.PLATFORM) -> DataFrame:
    """Expanded items -> comment rows (blank bodies skipped)."""
    j = expanded.select("story_id", "id", "depth", "path").join(
        items.select("id", "text", "by", "score", "time", "parent", "type"), "id")
    ok = j.where((F.col("type") == "comment") & ~is_blank(F.col("text")))
    ext = F.col("id").cast("string")
    return ok.select(
        F.lit(platform).alias("platform"), ext.alias("external_id"), "story_id", "depth", "path",
        F.col("text").alias("body"), author_hash(F.col("by")).alias("author_hash"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("time", F.lit(0)).alias("created_utc"),
        F.nullif(F.col("parent"), F.lit(0)).cast("string").alias("parent_comment_id"),
        permalink(ext).alias("permalink"))


def dedup_latest(rows: DataFrame, keys=("platform", "external_id"),
                 by: str = "ingested_at") -> DataFrame:
    """Latest version per natural key (skew-safe max_by aggregate)."""
    return last_per_key(rows, list(keys), [F.col(by)])


def upsert(existing: DataFrame, incoming: DataFrame, key: str | list[str],
           refresh: list[str], newer: str | None = None) -> DataFrame:
    """Keyed merge of an incoming batch into a table.

    ``key`` is a column or several, such as (platform, external_id). New keys
    are inserted whole; for keys already present only the ``refresh`` columns
    take the incoming value (Q15: e.g. a comment body is never refreshed);
    existing rows without a match are kept. Incoming duplicates must be
    removed first (dedup_latest). With ``newer`` a row that is older by that
    column than the stored one refreshes nothing, and the column keeps the later value.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = existing.columns
    e = existing.select(*[F.col(c).alias("e_" + c) for c in cols], F.lit(True).alias("_e"))
    i = incoming.select(*[F.col(c).alias("i_" + c) for c in cols], F.lit(True).alias("_i"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col("e_" + k) == F.col("i_" + k))
    j = e.join(i, same, "full_outer")
    out = []
    stale = F.lit(False)
    if newer is not None:
        stale = F.coalesce(F.col("e_" + newer) > F.col("i_" + newer), F.lit(False))
        refresh = [*refresh, newer]
    for c in cols:
        if c in refresh:
            out.append(F.when(stale, F.col("e_" + c)).otherwise(F.coalesce(F.col("i_" + c), F.col("e_" + c))).alias(c))
        else:
            out.append(F.when(F.col("_e"), F.col("e_" + c)).otherwise(F.col("i_" + c)).alias(c))
    status = (F.when(F.col("_e").isNull(), "inserted")
              .when(F.col("_i").isNull(), "kept").otherwise("updated"))
    return j.select(*out, status.alias("merge_status"))


def topic_names(stories: DataFrame, title_col: str = "title", id_col: str = "story_id",
                max_chars: int | None = lexicon.TITLE_MAX) -> DataFrame:
    """Topic name = title[:255] (the name column's width; None: whole title);
    on a name clash every story but the first (lowest id) gets ``title[:240] (#id)``. The first id per title is a
    min aggregate joined back (skew-safe), not a window over the title."""
    whole = F.col(title_col)
    title = whole if max_chars is None else F.substring(whole, 1, max_chars)
    t = stories.select(id_col, title.alias("title"))
    firsts = t.groupBy("title").agg(F.min(id_col).alias("_first"))
    prefix = F.col("title") if max_chars is None else F.substring("title", 1, lexicon.TITLE_COLLISION_PREFIX)
    renamed = F.concat(prefix,
                       F.lit(" (#"), F.col(id_col).cast("string"), F.lit(")"))
    return (t.join(firsts, "title")
            .select(id_col, "title", F.when(F.col(id_col) == F.col("_first"), F.col("title"))
                    .otherwise(renamed).alias("name")))


def lookup_ordered(ids: DataFrame, items: DataFrame) -> DataFrame:
    """Ordered batch lookup - (request_id, ids array) -> one row per
    position with the item's columns, NULLs for a miss, ordered by position."""
    exploded = ids.select("request_id", F.posexplode("ids").alias("pos", "id"))
    return exploded.join(items, "id", "left").orderBy("request_id", "pos")


def to_posts(stories: DataFrame, platform: str = lexicon.PLATFORM) -> DataFrame:
    """Story items -> post rows with the null defaults
    (title '', text '', score 0, time 0) and comma-joined target terms."""
    from agora.functions.text import target_entities
    title = F.substring(F.coalesce("title", F.lit("")), 1, lexicon.TITLE_MAX)
    ext = F.col("id").cast("string")
    return stories.select(
        F.lit(platform).alias("platform"), ext.alias("external_id"), title.alias("title"),
        F.coalesce("text", F.lit("")).alias("selftext"), author_hash(F.col("by")).alias("author_hash"),
        F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("time", F.lit(0)).alias("created_utc"),
        permalink(ext).alias("permalink"),
        F.array_join(target_entities(title), ",").alias("target_terms"))
