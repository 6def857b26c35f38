"""Ordered operations that survive hot keys: top-n, lag, running totals.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts a whole key in one task. Everything here first
cuts a key into sub-groups (salt, range of the order), works inside those, and
carries a small per-sub-group summary across.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import cut, session_options

#: Rows of a range, on average; what one task sorts.
BUCKET_ROWS = 100_000
WINDOW_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    salts: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of every key (of the table, without keys) in ``order``.

    Two passes: the winners of each salted part of a key, then the winners among at most ``n * salts``
    survivors. The salt is the source partition: a map task keeps ``n`` rows of a key at most, and a
    reducer sees few tasks' rows of a key. By default there are as many salts as the square root of the
    shuffle partitions. Spark limits a window before its shuffle up to a threshold only; for a greater ``n`` it is
    raised while the result is made, at once, and then set back.
    """
    conf = df.sparkSession.conf
    if salts is None:
        salts = max(1, math.isqrt(int(conf.get("spark.sql.shuffle.partitions"))))
    salted = df.withColumn("__salt", F.spark_partition_id() % salts)
    first = W.partitionBy(*keys, "__salt").orderBy(*order)
    survivors = salted.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= n).drop("__rn", "__salt")
    if not keys:
        found = survivors.orderBy(*order).limit(n)
    else:
        final = W.partitionBy(*keys).orderBy(*order)
        found = survivors.withColumn("__rn", F.row_number().over(final)).where(F.col("__rn") <= n).drop("__rn")
    if n <= int(conf.get(WINDOW_LIMIT, "1000")):
        return found
    with session_options(df.sparkSession, {WINDOW_LIMIT: str(n)}):
        return cut(found)


def in_ranges(df: DataFrame, order: Sequence[Column | str], out: str, rows: int | None = None) -> DataFrame:
    """Add the number of the range that a row falls into; ranges follow ``order`` and hold about ``rows`` rows.

    Bounds come from a sample of whole ``order`` tuples, so a key of any size is cut where its own rows lie, however
    close their values are; rows equal in all of ``order`` share a range. The result is fixed in shared storage, as
    bounds drawn anew after a lost executor could differ.
    """
    ranges = max(1, -(-df.count() // (rows or BUCKET_ROWS)))
    if ranges == 1:
        return df.withColumn(out, F.lit(0))
    return cut(df.repartitionByRange(ranges, *order).withColumn(out, F.spark_partition_id()))


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    value: str,
    out: str,
    rows: int | None = None,
) -> DataFrame:
    """``lag(value)`` per key in (ts, tie) order, computed per range of (key, ts, tie).

    Ranges hold about ``rows`` rows, whatever stretch of time that is: a million rows of a key in one minute are
    many ranges. Inside a range it is an ordinary lag. Only the first row of a key in a range needs a value
    from outside: it is found among the first and last rows of the key in all ranges. Both branches read the same
    shuffle, and there is no join.
    """
    sliced = in_ranges(df, [*keys, ts, tie], "__slice", rows)
    in_slice = W.partitionBy(*keys, "__slice").orderBy(ts, tie)
    marked = (
        sliced.withColumn("__row", F.row_number().over(in_slice))
        .withColumn(out, F.lag(value).over(in_slice))
        .withColumn("__end", F.lead(F.lit(1)).over(in_slice).isNull())
    )
    inner = marked.where(F.col("__row") > 1)
    edges = marked.where((F.col("__row") == 1) | F.col("__end"))
    across = W.partitionBy(*keys).orderBy(ts, tie)
    firsts = edges.withColumn(out, F.lag(value).over(across)).where(F.col("__row") == 1)
    return inner.unionByName(firsts).drop("__slice", "__row", "__end")


def running_totals(
    df: DataFrame,
    order_col: str,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive) and ``all_<m>`` to a table with one row per key and order value.

    Rows are put in ranges of (key, value); totals of the ranges give the offset of each, and the window runs inside a
    range only. A range holds about ``BUCKET_ROWS`` rows, also of a key that has a third of all of them
    in a narrow stretch of values; ``buckets`` sets their number instead. Null keys are a key.
    """
    rows = None if buckets is None else max(1, -(-df.count() // buckets))
    placed = in_ranges(df, [*keys, order_col], "__b", rows)
    if descending:
        placed = placed.withColumn("__b", -F.col("__b"))
    totals = placed.groupBy(*keys, "__b").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    one = [F.lit(0)] if not keys else list(keys)
    before = W.partitionBy(*one).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*one)
    offsets = totals.select(
        *keys,
        "__b",
        *[F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures],
        *[F.sum(f"__t_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    direction = F.col(order_col).desc() if descending else F.col(order_col).asc()
    inside = W.partitionBy(*keys, "__b").orderBy(direction).rowsBetween(W.unboundedPreceding, 0)
    names = [*keys, "__b"]
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in names])
    joined = placed.join(offsets.withColumnsRenamed({c: f"__at_{c}" for c in names}), same)
    return joined.select(
        *df.columns,
        *[(F.col(f"__o_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
    )
