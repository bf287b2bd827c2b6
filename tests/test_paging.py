"""Any page equals the same slice of the sorted table."""

import random

import pytest

from agora.operators import paging


def test_pages_equal_the_sorted_table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, -5, 0, 0, 0, 7, 1 << 40, -(1 << 61), rng.randint(-1000, 1000)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score long").persist()
    for descending in (True, False):
        def order(r):
            return (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, -r[0])
        want = sorted(rows, key=order)
        for offset, limit, small in ((0, 5, 4), (123, 60, 8), (395, 10, 3), (200, 50, 1000), (400, 5, 5), (3, 0, 5)):
            got = [tuple(r) for r in paging.page(df, [("score", descending), ("id", True)], offset, limit, small).collect()]
            assert got == want[offset:offset + limit], (descending, offset, limit, small)
    df.unpersist()


def test_only_the_page_s_range_is_sorted(spark):
    df = spark.range(100_000).withColumnRenamed("id", "k")
    page = paging.page(df, [("k", True)], 60_000, 10, small=100)
    assert [r[0] for r in page.collect()] == list(range(39_999, 39_989, -1))
    pieces = paging._pieces(df, [("k", True)], 60_000, 10, 100, [], None)
    assert sum(df.where(c[0][0] if len(c[0]) == 1 else c[0][0] & c[0][-1]).count() for c in pieces) <= 200


def test_empty_and_wrong(spark):
    df = spark.range(3).where("id < 0")
    assert paging.page(df, [("id", False)], 0, 10).count() == 0
    with pytest.raises(ValueError):
        paging.page(df, [], 0, 10)
    with pytest.raises(ValueError):
        paging.page(df, [("id", False)], -1, 10)
