"""Exact ranks in hash order without a global sort.

The order key of a row is a uniform number made from the md5 of its identifying columns. A cut "the
first k rows of this order" is turned into a limit on that number: the k-th smallest value is found by
histogram refinement (:mod:`tideline.operators.quantiles`), after which membership is a plain
comparison per row, and the table itself is never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.quantiles import order_statistics
from tideline.session import broadcast_if_small, cut

DIGITS = 13  # hex digits of the order key; below 2**52, so exact as a double


def row_digest(ids: Sequence[str], seed: int | str) -> Column:
    """md5 over seed and identifying columns."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ids]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def order_key(ids: Sequence[str], seed: int | str) -> Column:
    return F.conv(F.substring(row_digest(ids, seed), 1, DIGITS), 16, 10).cast("double")


def _limit_table(
    df: DataFrame, ids: Sequence[str], draws: Mapping[str, Sequence[Column]], strata: Sequence[str]
) -> DataFrame:
    """``draw, strata, limits``: for each cut the greatest order key still inside."""
    entries = F.array(*[F.struct(F.lit(d).alias("draw"), order_key(ids, d).alias("value")) for d in draws])
    rows = df.select(*strata, F.explode(entries).alias("e")).select("e.draw", *strata, "e.value")
    group = ["draw", *strata]
    picks = F.lit(None)
    for draw, cuts in draws.items():
        picks = F.when(F.col("draw") == draw, F.array(*[c.cast("long") for c in cuts])).otherwise(picks)
    # Order keys are uniform on a known range, so the search starts from the row counts alone.
    bounds = cut(
        df.groupBy(*strata)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("*", F.explode(F.array(*[F.lit(d) for d in draws])).alias("draw"), F.lit(0.0).alias("lo"), F.lit(16.0**DIGITS).alias("hi"))
        .withColumn("cuts", picks)
    )
    inner = F.filter("cuts", lambda c: (c > 0) & (c < F.col("n")))
    ranks = F.array_distinct(F.flatten(F.transform(inner, lambda c: F.array(c - 1, c))))
    stats = order_statistics(rows, bounds.withColumn("ranks", ranks).where(F.size("ranks") > 0), group)
    at = stats.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    known = bounds.select(*[F.col(g).alias(f"__{g}") for g in group], "n", "cuts")
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    limit = lambda c: F.when(c <= 0, F.lit(-1.0)).when(c >= F.col("n"), F.lit(float(16**DIGITS))).otherwise(
        F.when(F.col("at")[c - 1] < F.col("at")[c], F.col("at")[c - 1])
    )
    return known.join(at, on, "left").select(
        *[F.col(f"__{g}").alias(g) for g in group], F.transform("cuts", limit).alias("limits")
    )


def _require_ids(limits: DataFrame) -> None:
    if not limits.where(F.exists("limits", lambda v: v.isNull())).isEmpty():
        raise ValueError("several rows share the order key at a cut: the id columns must identify a row")


def hash_limits(df: DataFrame, ids: Sequence[str], draws: Mapping[str, Sequence[Column]]) -> dict[str, list[float]]:
    """Limits of several draws over the whole table; a cut is an expression over the row count ``n``."""
    table = cut(_limit_table(df, ids, draws, ()))
    _require_ids(table)
    found = {r["draw"]: list(r["limits"]) for r in table.collect()}  # one row per draw
    return {d: found.get(d, [-1.0] * len(c)) for d, c in draws.items()}


def band_column(ids: Sequence[str], seed: int | str, limits: Sequence[float]) -> Column:
    """Number of limits below the order key of a row."""
    band = F.lit(0)
    for limit in limits:
        band = band + (order_key(ids, seed) > F.lit(limit)).cast("int")
    return band


def hash_bands(
    df: DataFrame,
    ids: Sequence[str],
    seed: int | str,
    cuts: Sequence[Column],
    strata: Sequence[str] = (),
    out: str = "band",
) -> DataFrame:
    """Add the number of ``cuts`` below the hash rank of a row, per stratum.

    A cut is an expression over ``n``, the size of the stratum. ``ids`` must identify a row; where they
    do not and a cut falls into copies, an error is raised.
    """
    draw = str(seed)
    if not strata:
        return df.withColumn(out, band_column(ids, seed, hash_limits(df, ids, {draw: cuts})[draw]))
    limits = broadcast_if_small(_limit_table(df, ids, {draw: cuts}, strata))
    _require_ids(limits)
    limits = limits.select(*[F.col(s).alias(f"__{s}") for s in strata], F.col("limits").alias("__limits"))
    on = F.lit(True)
    for s in strata:
        on = on & F.col(s).eqNullSafe(F.col(f"__{s}"))
    key = order_key(ids, seed)
    band = F.lit(0)
    for i in range(len(cuts)):
        band = band + (key > F.get("__limits", F.lit(i))).cast("int")
    return df.join(limits, on).select(*df.columns, band.alias(out))


def dense_hash_position(
    df: DataFrame, ids: Sequence[str], seed: int | str, out: str = "position", bucket_rows: int = 10_000
) -> DataFrame:
    """0-based position of every row in hash order, ranked inside uniform buckets of about ``bucket_rows``."""
    digits = max(1, math.ceil(math.log(max(1, df.count() / bucket_rows), 16)))
    keyed = df.withColumn("__d", row_digest(ids, seed))
    keyed = keyed.withColumn("__hb", F.conv(F.substring("__d", 1, digits), 16, 10).cast("int"))
    run = W.partitionBy(F.lit(0)).orderBy("__hb").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("__hb")
        .agg(F.count(F.lit(1)).alias("__c"))
        .select("__hb", F.coalesce(F.sum("__c").over(run), F.lit(0)).alias("__before"))
    )
    inside = W.partitionBy("__hb").orderBy("__d")
    return (
        keyed.join(offsets, "__hb")
        .withColumn(out, F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__d", "__hb", "__before")
    )
