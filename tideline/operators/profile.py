"""Reference statistics: numeric profiles, bin edges, histograms, category shares, class shares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.quantiles import exact_quantiles, finite_or_null, rank_sketch
from tideline.session import broadcast_if_small, cut

DECILES = tuple(i / 10 for i in range(1, 10))
BINS = 10
_CLASS = "__class"


@dataclass(frozen=True)
class ReferenceProfile:
    """The three tables a drift comparison needs."""

    numeric: DataFrame  # keys, feature, n, mean, std, deciles, edges, bin_counts
    categorical: DataFrame  # keys, feature, category, freq
    output: DataFrame  # keys, class, share


def present(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The wanted features the table has, in the wanted order."""
    return [f for f in features if f in df.columns]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _no_rows(df: DataFrame, keys: Sequence[str], name: str, kind: str) -> DataFrame:
    empty = df.where(F.lit(False))
    return empty.select(*keys, F.lit("").alias("feature"), F.lit(None).cast(kind).alias(name))


def long_numeric(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, value`` with NaN as NULL; one scan for all features."""
    features = present(df, features)
    if not features:
        return _no_rows(df, keys, "value", "double")
    cast = df.select(*keys, *[finite_or_null(_quoted(f)).alias(f) for f in features])
    return cast.unpivot(list(keys), [_quoted(f) for f in features], "feature", "value")


def long_categorical(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, category`` as strings, NULLs kept."""
    features = present(df, features)
    if not features:
        return _no_rows(df, keys, "category", "string")
    cast = df.select(*keys, *[_quoted(f).cast("string").alias(f) for f in features])
    return cast.unpivot(list(keys), [_quoted(f) for f in features], "feature", "category")


def interior_edges(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def bin_of(value: Column, edges: Column, bins: int) -> Column:
    """Right-open bin 0..bins-1; a value on an edge passes all copies of that edge."""
    index = F.lit(0)
    for i in range(bins - 1):
        index = index + (value >= F.get(edges, F.lit(i))).cast("int")
    return index


def bin_counts(bin_index: Column, bins: int) -> Column:
    """Dense count array, empty bins included; NULL bins are not counted."""
    return F.array(*[F.count_if(bin_index == i) for i in range(bins)])


def numeric_moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, n`` (with missing), ``mean, std`` (sample), ``lo, hi, filled`` and the ``sketch`` of ranks."""
    return (
        long_numeric(df, features, keys)
        .groupBy(*keys, "feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.count("value").alias("filled"),
            rank_sketch("value").alias("sketch"),
        )
    )


def numeric_profile(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = (), bins: int = BINS
) -> DataFrame:
    """One row per (key and) feature: ``n, mean, std, deciles, edges, bin_counts``.

    Features without any value keep NULL arrays. The histogram of the reference falls out of the
    quantile search, which knows how many values lie below each edge.
    """
    group = [*keys, "feature"]
    moments = cut(numeric_moments(df, features, keys))
    edges = interior_edges(bins)
    probs = [*DECILES, *[e for e in edges if e not in DECILES]]
    bounds = moments.select(*group, "lo", "hi", F.col("filled").alias("n"), "sketch")
    quantiles = exact_quantiles(long_numeric(df, features, keys), probs, group, bounds=bounds)
    at = [probs.index(e) for e in edges]
    below = [F.lit(0).cast("long"), *[F.get("below", F.lit(i)) for i in at], F.col("filled")]
    found = F.col("quantiles").isNotNull()
    profile = moments.join(quantiles, group, "left").select(
        *group,
        "n",
        "mean",
        "std",
        F.when(found, F.slice("quantiles", 1, len(DECILES))).alias("deciles"),
        F.when(found, F.array(*[F.get("quantiles", F.lit(i)) for i in at])).alias("edges"),
        F.when(found, F.array(*[b - a for a, b in zip(below, below[1:])])).alias("bin_counts"),
    )
    return cut(profile)  # read twice by a comparison: edges and counts


def histogram(
    df: DataFrame,
    profile: DataFrame,
    features: Sequence[str],
    bins: int = BINS,
    keys: Sequence[str] = (),
    profile_keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, feature, current_n, bin_counts`` of ``df`` over the edges of a profile.

    A profile without keys has one row per column of the schema, hence the broadcast.
    """
    group = [*profile_keys, "feature"]
    edges = profile.select(*group, "edges")
    edges = broadcast_if_small(edges) if profile_keys else F.broadcast(edges)
    return (
        long_numeric(df, features, keys)
        .join(edges, group)
        .groupBy(*keys, "feature")
        .agg(
            F.count(F.lit(1)).alias("current_n"),
            bin_counts(bin_of(F.col("value"), F.col("edges"), bins), bins).alias("bin_counts"),
        )
    )


def category_counts(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, category, count``; missing values form a NULL category."""
    return long_categorical(df, features, keys).groupBy(*keys, "feature", "category").count()


def _shares(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = counts.where(F.col("category").isNotNull())
    totals = counts.groupBy(*keys, "feature").agg(F.sum("count").alias("total"))
    return counts.join(totals, [*keys, "feature"]).select(
        *keys, "feature", "category", (F.col("count") / F.col("total")).alias("freq")
    )


def categorical_profile(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of each category among non-null values."""
    return _shares(category_counts(df, features, keys), keys)


def _class_shares(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = F.nullif(F.sum(F.when(F.col("category").isNotNull(), F.col("count"))), F.lit(0))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("count"))) / known, F.lit(0.0))
    both = counts.groupBy(*keys).agg(of("0").alias("zero"), of("1").alias("one"))
    pairs = [F.struct(F.lit(c).alias("class"), F.col(n).alias("share")) for c, n in (("0", "zero"), ("1", "one"))]
    return both.select(*keys, F.explode(F.array(*pairs)).alias("c")).select(*keys, "c.class", "c.share")


def class_proportions(df: DataFrame, label: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, class, share`` for classes 0 and 1; an absent class has share 0."""
    counts = df.select(*keys, label.cast("int").cast("string").alias("category"))
    return _class_shares(counts.groupBy(*keys, "category").count(), keys)


def reference_profile(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: Column,
    keys: Sequence[str] = (),
    bins: int = BINS,
) -> ReferenceProfile:
    """All reference statistics of a table, fixed in shared storage for the comparisons that follow.

    ``label`` is the predicted class (0/1).
    """
    categorical = [c for c in present(df, categorical) if c != _CLASS]
    counts = cut(category_counts(df.withColumn(_CLASS, label.cast("int")), [*categorical, _CLASS], keys))
    return ReferenceProfile(
        numeric_profile(df, numeric, keys, bins),
        cut(_shares(counts.where(F.col("feature") != _CLASS), keys)),
        cut(_class_shares(counts.where(F.col("feature") == _CLASS), keys)),
    )
