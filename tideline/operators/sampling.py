"""Reproducible samples and splits by hash rank; no random generator, no global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.hashrank import dense_hash_position, hash_bands, row_digest

SEED = 42


def _check_shares(val: float, test: float) -> None:
    if not 0 < val + test < 1:
        raise ValueError("val + test must lie strictly between 0 and 1")


def stratified_split(
    df: DataFrame, label: str, ids: Sequence[str], val: float = 0.2, test: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Exact split per class: hold back ``val + test``, then divide the held rows. Adds ``split``."""
    _check_shares(val, test)
    held = F.ceil(F.col("n") * F.lit(val + test))
    tested = F.ceil(held * F.lit(test / (val + test)))
    cuts = [F.col("n") - held, F.col("n") - tested]
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    return hash_bands(df, ids, seed, cuts, [label], "__band").withColumn("split", F.get(names, F.col("__band"))).drop("__band")


def stratified_split_by_threshold(
    df: DataFrame, ids: Sequence[str], val: float = 0.2, test: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Split with expected (not exact) shares: one look at the row's own hash, no counting pass."""
    _check_shares(val, test)
    u = F.conv(F.substring(row_digest(ids, seed), 1, 8), 16, 10).cast("long") / F.lit(float(16**8))
    return df.withColumn(
        "split", F.when(u < 1 - (val + test), "train").when(u < 1 - test, "val").otherwise("test")
    )


def exact_sample(df: DataFrame, n: int, ids: Sequence[str], seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement (all rows if there are fewer)."""
    return hash_bands(df, ids, seed, [F.lit(n)], out="__band").where(F.col("__band") == 0).drop("__band")


def sample_with_replacement(df: DataFrame, n: int, ids: Sequence[str], seed: int = SEED) -> DataFrame:
    """``n`` draws; draw ``i`` takes the row at a hashed position."""
    size = df.count()
    digest = F.md5(F.concat_ws("|", F.lit(f"draw{seed}"), F.col("draw").cast("string")))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn(
        "position", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(size)
    )
    return draws.join(dense_hash_position(df, ids, seed), "position").drop("position")


def sample(df: DataFrame, n: int, ids: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows; with replacement only if the source is smaller."""
    if df.count() < n:
        return sample_with_replacement(df, n, ids, seed).drop("draw")
    return exact_sample(df, n, ids, seed)


def class_conditional_sample(
    df: DataFrame, n: int, positive: Column, ids: Sequence[str], seed: int = SEED
) -> DataFrame:
    """Sample of positives if there are at least ``max(50, n // 4)`` of them, else of all rows."""
    positives = df.where(positive)
    enough = positives.count() >= max(50, n // 4)
    return sample(positives if enough else df, n, ids, seed)


def set_fraction(
    df: DataFrame,
    column: str,
    value: str,
    fraction: float,
    ids: Sequence[str],
    seed: int | str = SEED,
    source: DataFrame | None = None,
) -> DataFrame:
    """Set ``column`` to ``value`` on exactly ``max(1, int(n * fraction))`` rows.

    Does nothing if ``source`` never shows that value.
    """
    if column not in df.columns:
        return df
    if source is not None:
        if column not in source.columns or source.where(F.col(column).cast("string") == value).isEmpty():
            return df
    size = F.greatest(F.floor(F.col("n") * F.lit(fraction)), F.lit(1))
    banded = hash_bands(df, ids, seed, [size], out="__band")
    changed = F.when(F.col("__band") == 0, F.lit(value)).otherwise(F.col(column))
    return banded.withColumn(column, changed).select(*df.columns)
