"""Small distributed building blocks shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.session import ensure_checkpoint_dir

#: Posts up to this count are broadcast; a post's terms come from a title of at most 255 characters.
BROADCAST_POSTS = 100_000
SALTS = 16


def prior_running_sum(df: DataFrame, order_key: str, value: str, out: str,
                      block_size: int = 4096, levels: int = 3) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``order_key``.

    A prefix sum over ``levels`` levels of blocks: rows are cut into blocks by
    key (block = key // block_size) with a local running sum each (a window
    partitioned by block); the blocks' totals are summed the same way one
    level up. Only the last level is one window over all its rows, of which
    there is one per block_size ** levels keys. ``order_key`` must be a
    non-negative integer column.
    """
    blk = F.floor(F.col(order_key) / F.lit(block_size)).cast("bigint")
    with_blk = df.withColumn("_blk", blk)
    w_local = (Window.partitionBy("_blk").orderBy(order_key)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = with_blk.withColumn("_local", F.coalesce(F.sum(value).over(w_local), F.lit(0)))
    totals = with_blk.groupBy("_blk").agg(F.sum(value).alias("_btotal"))
    if levels > 1:
        named = totals.select(F.col("_blk").alias("_key"), "_btotal")
        offsets = (prior_running_sum(named, "_key", "_btotal", "_above", block_size, levels - 1)
                   .select(F.col("_key").alias("_blk"), F.col("_above").alias("_boffset")))
    else:
        w_blocks = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select("_blk", F.coalesce(F.sum("_btotal").over(w_blocks), F.lit(0))
                                .alias("_boffset"))
    return (local.join(offsets, "_blk", "left")
            .withColumn(out, (F.col("_local") + F.coalesce("_boffset", F.lit(0))).cast("bigint"))
            .drop("_blk", "_local", "_boffset"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep, per key, the row that sorts first by ``order``.

    A ``min_by`` aggregation instead of a row_number window: it aggregates
    map-side, so a key holding a large share of the rows (many copies) is
    reduced before the shuffle instead of landing whole in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    ordering = F.struct(*order)
    return (df.groupBy(*keys).agg(F.min_by(packed, ordering).alias("_row"))
            .select(*keys, *[F.col("_row." + c).alias(c) for c in others]))


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep, per key, the row that sorts last by ``order`` (max_by)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("_row"))
            .select(*keys, *[F.col("_row." + c).alias(c) for c in others]))


def with_target_terms(comments: DataFrame, posts: DataFrame, row_key: str = "comment_id",
                      limit: int = BROADCAST_POSTS) -> DataFrame:
    """``comments`` with their post's ``target_terms`` (null without a post).

    Comments carry whole texts, and one post may hold a third of them, so they
    are not dealt by post. The posts' terms are written once and counted: up to
    ``limit`` they are broadcast and no comment moves; beyond it both sides are
    dealt by post and salt, every post once per salt.
    """
    ensure_checkpoint_dir(posts.sparkSession)
    terms = posts.select("post_id", "target_terms").checkpoint()
    if terms.count() <= limit:
        return comments.join(F.broadcast(terms), "post_id", "left")
    salted = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = comments.withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["post_id", "_salt"], "left").drop("_salt")
