"""Delimited and Parquet tables: read, write, fingerprint, reference statistics, run metrics, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.operators.profile import ReferenceProfile

_PARTS = ("numeric", "categorical", "output")


def read_table(spark: SparkSession, path: str, sep: str = ";", schema: StructType | str | None = None) -> DataFrame:
    """Delimited table with a header. Without a schema the types are inferred (one more pass)."""
    reader = spark.read.option("header", True).option("sep", sep)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_batch(
    spark: SparkSession, path: str, limit: int | None = None, order_by: Sequence[str] = (), sep: str = ","
) -> DataFrame:
    """Delimited batch with every column a string; the first ``limit`` rows in ``order_by``."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    if limit is None:
        return rows
    if not order_by:
        raise ValueError("a limit needs an explicit order")
    return rows.orderBy(*order_by).limit(limit)


def write_table(df: DataFrame, path: str, sep: str = ";", partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).partitionBy(*partition_by).csv(path)


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash: row count and the sums of two halves of every row's md5.

    Columns enter by name order, so neither row nor column order matters.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]
    digest = F.md5(F.concat_ws("\u0001", *parts))

    def half(start: int) -> F.Column:
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")

    sums = df.select(half(1).alias("a"), half(16).alias("b")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    text = F.concat_ws(":", "n_rows", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string"))
    return sums.select("n_rows", F.sha2(text, 256).alias("fingerprint"))


def save_profile(profile: ReferenceProfile, path: str) -> None:
    """The three tables appear together, as the next version under ``path``, or not at all."""
    from tideline.sources.versioned import publish  # which builds on this module

    publish(profile.numeric.sparkSession, path, {part: getattr(profile, part) for part in _PARTS})


def load_profile(spark: SparkSession, path: str) -> ReferenceProfile:
    """The newest version that :func:`save_profile` has written."""
    from tideline.sources.versioned import read_version

    found = read_version(spark, path)
    if found.number < 0:
        raise FileNotFoundError(f"no reference statistics under {path}")
    return ReferenceProfile(*[found.table(part) for part in _PARTS])


def append_run_metrics(metrics: DataFrame, path: str) -> None:
    """Append rows of a training or replay run to its metrics table."""
    metrics.write.mode("append").parquet(path)


def upsert_latest(state: DataFrame, updates: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Snapshot after insert-or-overwrite: per key the row with the greatest ``order``.

    A ``max_by`` aggregate, so a hot key is reduced before the shuffle. ``order`` should end with a
    column that breaks ties.
    """
    rest = [c for c in state.columns if c not in key]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return (
        state.unionByName(updates.select(*state.columns))
        .groupBy(*key)
        .agg(latest)
        .select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])
        .select(*state.columns)
    )
