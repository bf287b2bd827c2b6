"""Connected components of an edge list by alternating large and small stars.

Every round is two aggregations to one row per node and two joins on it, with
the edges checkpointed, so a hub with very many neighbours costs partial
minimums and a skewed join that Spark splits; no component is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import prepare



def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v; ``both``: the large star."""
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = arcs.join(least, "u")
    if both:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; ``edges``: two bigint columns, any order.

    The component's name is its smallest node. Edges with a null end and loops are left out.
    """
    prepare(edges.sparkSession)
    a, b = edges.columns
    now = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct().checkpoint())
    mark = None
    while True:
        now = _star(_star(now, True), False).checkpoint()
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()  # one row
        if seen == mark:
            break
        mark = seen
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
