"""Pages at any depth without sorting the table (K4).

``sort().offset(n)`` sorts everything to skip n rows. Here counts locate the
page first: the span of the first sort key is cut into at most
``RANGES`` equal ranges, one aggregation counts the rows of each (summed beside the scan, at
most RANGES + 1 rows come back), and the ranges that hold the page are cut
again until they hold no more than ``small`` rows, or are a single value, which
is then cut by the next key. Only the rows of those ranges are sorted, and the
bounds are plain comparisons that a Parquet scan can use to skip row groups.

Keys are integral columns; together they should be unique, as otherwise the
choice among rows with equal keys is open. A null key sorts last, whatever the
direction. A page beyond the end is short or empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 1024


def _directed(key: tuple[str, bool]) -> Column:
    name, descending = key
    return F.desc_nulls_last(name) if descending else F.asc_nulls_last(name)


def _counts(rows: DataFrame, name: str, low: int, bits: int) -> dict[int | None, int]:
    at = F.shiftright(F.col(name).cast("long") - F.lit(low).cast("long"), bits)
    got = rows.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()  # RANGES + 1 rows
    return {r["at"]: r["n"] for r in got}


def _pieces(df: DataFrame, keys: list[tuple[str, bool]], offset: int, limit: int, small: int,
            given: list[Column], span: tuple[int, int] | None) -> list[tuple[list[Column], int, int]]:
    """(conditions, rows to skip, rows to take) that make up the page, in order. ``span`` bounds the first key."""
    (name, descending), later = keys[0], keys[1:]
    rows = df.where(reduce(lambda a, b: a & b, given)) if given else df
    if span is None:
        low, high = rows.agg(F.min(name), F.max(name)).first()  # two numbers
        low, high = (0, 0) if low is None else (int(low), int(high))
    else:
        low, high = span
    if high - low >= 1 << 63:
        raise ValueError(f"the values of {name} lie too far apart")
    bits = max((high - low).bit_length() - RANGES.bit_length() + 1, 0)
    width = 1 << bits
    counts = _counts(rows, name, low, bits)
    ordered = sorted((k for k in counts if k is not None), reverse=descending) + [k for k in (None,) if k in counts]
    pieces: list[tuple[list[Column], int, int]] = []
    before = 0
    for k in ordered:
        n = counts[k]
        skip, take = max(offset - before, 0), min(offset + limit, before + n) - max(offset, before)
        before += n
        if take <= 0:
            continue
        key = F.col(name)
        if k is None:
            here = [key.isNull()]
        else:
            first = low + k * width
            here = [(key >= first) & (key <= first + width - 1)]
        if n <= small or (not later and (width == 1 or k is None)):
            pieces.append(([*given, *here], skip, take))
        elif k is None or width == 1:
            pieces += _pieces(df, later, skip, take, small, [*given, *here], None)
        else:
            pieces += _pieces(df, keys, skip, take, small, [*given, *here], (first, first + width - 1))
    return pieces


def page(df: DataFrame, keys: list[tuple[str, bool]], offset: int, limit: int, small: int = 50_000) -> DataFrame:
    """Rows offset .. offset + limit - 1 of ``df`` in the order of ``keys``, (column, descending) pairs."""
    if offset < 0 or limit < 0 or not keys:
        raise ValueError("offset and limit must not be negative, and there must be a key")
    order = [_directed(k) for k in keys]
    parts = [df.where(reduce(lambda a, b: a & b, conditions)).orderBy(*order).offset(skip).limit(take)
             for conditions, skip, take in (_pieces(df, keys, offset, limit, small, [], None) if limit else [])]
    if not parts:
        return df.limit(0)
    return reduce(DataFrame.unionByName, parts).orderBy(*order)
