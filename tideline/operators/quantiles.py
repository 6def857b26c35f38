"""Exact interpolated quantiles by repeated histogram refinement.

``percentile`` keeps every distinct value of a group in one task, ``percentile_approx`` moves bin
edges (and with them all ties). Here the rank of each wanted order statistic is fixed first. A KLL sketch,
made in the scan that also counts the rows, gives two values that most likely enclose it; one scan counts
exactly what lies below, between (in bins) and above. Should the sketch have missed, or a bin still hold many
rows, the range that must contain the rank is cut into bins again and again; each pass is one scan
with map-side counts, and only the rows of the last bins are ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import BROADCAST_ROWS, cut

BINS = 2048
SORTED_ROWS = 100_000
#: Size of a sketch (at most about 100 KB, never more than the rows it saw), bins between two enclosing values.
SKETCH = 4096
BRACKET_BINS = 128
#: Half the width of a bracket as a share of the rows: half as much again as the sketch's error at 99 %.
BRACKET = 1.5 * 2.296 / SKETCH**0.9723
_BIG = 1.7976931348623157e308


def finite_or_null(value: Column) -> Column:
    """NaN counts as missing."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def _bounded(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(_BIG)), F.lit(-_BIG))


def _bin(value: Column, lo: Column, hi: Column, bins: int, by_magnitude: bool) -> Column:
    """Monotone bin of a value in [lo, hi], by value or by signed logarithm.

    Equal widths suit most columns; the logarithm gets through tails that span many magnitudes. Both
    keep the order of values, so the choice changes the number of passes only.
    """
    v, a, b = (_bounded(c) / 2 for c in (value, lo, hi))  # halves keep b - a finite
    if by_magnitude:
        unit = F.greatest(F.abs(a), F.abs(b)) * F.lit(2.0**-60)
        v, a, b = (F.when(unit > 0, F.signum(c) * F.log(1 + F.abs(c) / unit)).otherwise(c) for c in (v, a, b))
    share = F.when(b > a, (v - a) / (b - a)).otherwise(F.lit(0.0))
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def rank_sketch(value: Column | str) -> Column:
    """Aggregate: what :func:`brackets` needs to know about a column of doubles. NULLs are left out."""
    return F.kll_sketch_agg_double(value, SKETCH)


def brackets(sketch: Column, n: Column, probs: Sequence[float]) -> Column:
    """Two values around each quantile, the lower ones first; NULL where there are no rows."""
    shares = [max(0.0, p - BRACKET) for p in probs] + [min(1.0, p + BRACKET) for p in probs]
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(x) for x in shares])))


def _fences(wanted: DataFrame, n_probs: int) -> DataFrame:
    """Per group the enclosing values in order, ``fence`` (filled up with NaN, which no value reaches), and whether a
    bracket covers the room after each, ``dense``."""
    pairs = F.arrays_zip(F.slice("cuts", 1, n_probs).alias("low"), F.slice("cuts", n_probs + 1, n_probs).alias("high"))
    distinct = F.array_sort(F.array_distinct("cuts"))
    fenced = wanted.withColumn("fence", F.concat(distinct, F.array_repeat(F.lit(float("nan")), F.lit(2 * n_probs) - F.size(distinct))))
    covered = lambda a, j: F.exists(pairs, lambda p: (p["low"] <= a) & (p["high"] >= F.get("fence", j + 1)))
    return fenced.withColumn("dense", F.transform("fence", covered))


def _with_cell(rows: DataFrame, n_probs: int) -> DataFrame:
    """Monotone bin ``__bin`` of a value among the enclosing values.

    Each enclosing value is a bin of its own, so a hot value never shares one; inside a bracket the room between two
    neighbours has ``BRACKET_BINS`` bins, everywhere else a single one.
    """
    v, reached = F.col("__v"), F.col("__reached")
    above = [(v >= F.get("fence", F.lit(i))).cast("int") for i in range(2 * n_probs)]
    placed = rows.withColumn("__reached", reduce(Column.__add__, above))
    placed = placed.select("*", F.get("fence", reached - 1).alias("__a"), F.get("fence", reached).alias("__b"), F.get("dense", reached - 1).alias("__in"))
    inner = F.when(F.col("__in") & (v > F.col("__a")), _bin(v, F.col("__a"), F.col("__b"), BRACKET_BINS, False)).otherwise(0)
    cell = 2 * reached - F.coalesce((v == F.col("__a")).cast("int"), F.lit(0))
    return placed.withColumn("__bin", cell * BRACKET_BINS + inner)


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def order_statistics(
    rows: DataFrame,
    wanted: DataFrame,
    group: Sequence[str],
    value: str = "value",
    bins: int = BINS,
    sorted_rows: int = SORTED_ROWS,
    max_passes: int = 60,
    n_brackets: int = 0,
) -> DataFrame:
    """Values at 0-based ranks.

    ``wanted`` has one row per group: ``lo, hi, n`` of its non-null values and the array ``ranks``; it
    should be cheap to read (a checkpointed aggregate). With ``n_brackets`` it also has the array ``cuts`` of
    that many lower and then as many upper values (:func:`brackets`), which speed the search but cannot change
    its result. Returns ``group, rank, value, first, n``, where
    ``first`` is the lowest rank that shows this value, i.e. the number of smaller values.
    """
    group = list(group)
    rows = rows.select(*group, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    state = wanted.select(*group, "lo", "hi", F.lit(0).cast("long").alias("base"), F.col("n").alias("cnt"), "ranks", "n")
    is_open = F.col("lo") < F.col("hi")
    is_small = F.col("cnt") <= sorted_rows

    def inside(part: DataFrame, size: int, *more: str) -> DataFrame:
        """Rows falling into one of the open value ranges; ranges of a group are disjoint."""
        spans = _side(part.select(*[F.col(g).alias(f"__{g}") for g in group], "lo", "hi", *more), size)
        on = F.col("__v").between(F.col("lo"), F.col("hi"))
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
        return rows.join(spans, on).select(*group, "__v", "lo", "hi", *more)

    def with_ranks(counted: DataFrame, part: DataFrame, size: int, order: str) -> DataFrame:
        """Turn counts of ordered cells into rank offsets and keep the cells that hold a wanted rank."""
        upto = F.sum("__c").over(W.partitionBy(*group, "lo").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
        known = _side(part.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("lo").alias("__lo"), "base", "ranks", "n"), size)
        on = F.col("lo") == F.col("__lo")
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
        return (
            counted.withColumn("__upto", upto)
            .join(known, on)
            .withColumn("base", F.col("base") + F.col("__upto") - F.col("__c"))
            .withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("__c"))))
            .where(F.size("ranks") > 0)
        )

    passes: list[DataFrame] = []
    n_small = 0
    for number in range(max_passes):
        left = state.agg(F.count_if(is_open & is_small).alias("small"), F.count_if(is_open & ~is_small).alias("large")).first()
        passes.append(state)
        n_small += left["small"]
        if not left["large"]:
            break
        part = state.where(is_open & ~is_small)
        if number == 0 and n_brackets:
            fenced = _fences(wanted.where(is_open & (F.col("n") > sorted_rows)), n_brackets)
            binned = _with_cell(inside(fenced, left["large"], "fence", "dense"), n_brackets)
        else:
            binned = inside(part, left["large"]).withColumn(
                "__bin", _bin(F.col("__v"), F.col("lo"), F.col("hi"), bins, number % 2 == 1)
            )
        counted = (
            binned.groupBy(*group, "lo", "__bin")
            .agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        )
        state = cut(
            with_ranks(counted, part, left["large"], "__bin").select(
                *group, F.col("__min").alias("lo"), F.col("__max").alias("hi"), "base", F.col("__c").alias("cnt"), "ranks", "n"
            )
        )
    else:
        raise RuntimeError("value ranges did not narrow; raise bins or max_passes")

    # One last scan ranks the rows of all small ranges, whichever pass they come from.
    every = reduce(DataFrame.unionByName, passes)
    result = every.where(~is_open).select(*group, F.explode("ranks").alias("rank"), F.col("lo").alias("value"), F.col("base").alias("first"), "n")
    if n_small:
        part = every.where(is_open & is_small)
        counted = inside(part, n_small).groupBy(*group, "lo", "__v").agg(F.count(F.lit(1)).alias("__c"))
        sorted_part = with_ranks(counted, part, n_small, "__v").select(
            *group, F.explode("ranks").alias("rank"), F.col("__v").alias("value"), F.col("base").alias("first"), "n"
        )
        result = result.unionByName(sorted_part)
    return result


def exact_quantiles(
    rows: DataFrame,
    probs: Sequence[float],
    group: Sequence[str] = ("feature",),
    value: str = "value",
    bounds: DataFrame | None = None,
    bins: int = BINS,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per group: ``group, quantiles, below``.

    Both arrays follow the order of ``probs``; ``below`` counts the values smaller than each quantile,
    so histograms of the rows themselves need no further scan. ``bounds`` may bring ``group, lo, hi, n, sketch``
    (of the non-null values) from a profile, already checkpointed.
    """
    group = list(group)
    probs = [float(p) for p in probs]
    if bounds is None:
        bounds = cut(
            rows.groupBy(*group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"), rank_sketch(value).alias("sketch"))
        )
    spot = lambda p: (F.col("n") - 1) * p
    floors = [F.floor(spot(F.lit(p))) for p in probs]
    ceils = [F.least(f + 1, F.col("n") - 1) for f in floors]
    wanted = bounds.where(F.col("n") > 0).select(
        *group, "lo", "hi", "n", F.array_distinct(F.array(*floors, *ceils)).alias("ranks"), brackets(F.col("sketch"), F.col("n"), probs).alias("cuts")
    )
    stats = order_statistics(rows, wanted, group, value, bins, sorted_rows, n_brackets=len(probs))
    by_rank = stats.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", F.struct("value", "first")))).alias("at"),
        F.max("n").alias("n"),
    )
    # One small row per wanted quantile, then back to one row per group.
    low, high = F.floor(spot(F.col("p"))), F.least(F.floor(spot(F.col("p"))) + 1, F.col("n") - 1)
    a, b, t = F.col("a.value"), F.col("b.value"), spot(F.col("p")) - F.col("low")
    gap = F.when(a == b, F.lit(0.0)).otherwise(b - a)
    quantile = F.when(t == 0, a).when(t >= 0.5, b - gap * (1 - t)).otherwise(a + gap * t)
    return (
        by_rank.select(*group, "n", "at", F.posexplode(F.array(*[F.lit(p) for p in probs])).alias("i", "p"))
        .select(*group, "i", "p", "n", low.alias("low"), F.col("at")[low].alias("a"), F.col("at")[high].alias("b"))
        .select(*group, "i", "low", "a", quantile.alias("quantile"))
        .select(*group, "i", "quantile", F.when(F.col("quantile") == F.col("a.value"), F.col("a.first")).otherwise(F.col("low") + 1).alias("below"))
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("i", "quantile", "below"))).alias("q"))
        .select(*group, F.col("q.quantile").alias("quantiles"), F.col("q.below").alias("below"))
    )
