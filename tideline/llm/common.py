"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import scratch_path

# Ship task functions by value; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A key is hot if it holds this share of all rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there; survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_row(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``fn`` over the Arrow batches of the named columns only."""
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(fn, schema)


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in a text column (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def lookup(big: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``big`` with a table that has one row per key and its number of rows in ``big``.

    Keys that hold a thousandth of all rows or more, at most a thousand of them, are joined by a
    broadcast; so no key's rows meet in one task. Give settled tables: each is read twice.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(small.where(F.col(weight) >= max(1.0, total * HOT_SHARE)).drop(weight))
    cold = small.where(F.col(weight) < max(1.0, total * HOT_SHARE)).drop(weight)
    return big.join(hot, key).unionByName(big.join(hot, key, "left_anti").join(cold, key, "left"))
