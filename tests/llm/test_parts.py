"""Large buckets and cells, split into pairs of blocks, are dealt into groups of bounded size."""

from pyspark.sql import functions as F

from agora.llm import itq, minhash


def largest(placed):
    return placed.groupBy("part").count().agg(F.max("count")).first()[0]


def test_largest_group_of_a_large_bucket(spark):
    """One bucket of 300 texts in about 100 blocks of 3: 30,000 rows, a pair of blocks has about six."""
    members = spark.range(300).select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("key"),
                                      F.col("id").alias("rep"), F.col("id").alias("component"))
    placed, parts = minhash._placed(members, minhash.Settings(block=3))
    assert placed.count() == 300 * 100 and parts >= 300 * 100 / 6
    assert largest(placed) < 100


def test_largest_group_of_a_large_cell(spark):
    """One cell of 300 vectors of a megabyte each (as given), in blocks of 3."""
    coded = spark.range(300).selectExpr("id rep", "1L copies", "binary('v') vector", "array(5L) keys")
    placed, parts = itq._placed(coded, 1 << 20, itq.Settings(block=3))
    assert placed.count() == 300 * 100 and parts >= 300 * 100 / 24
    assert largest(placed) < 200
