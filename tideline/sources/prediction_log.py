"""The prediction log: id, features as JSON, label, probability, created_at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tideline.operators.ordered import top_n_per_key

WINDOW = 500  # default size of the rolling window


def to_log(scored: DataFrame, features: Sequence[str], id_col: Column, created_at: Column) -> DataFrame:
    """Log rows of a scored table (columns ``label`` and ``probability``)."""
    return scored.select(
        id_col.cast("string").alias("id"),
        F.to_json(F.struct(*features), {"ignoreNullFields": "false"}).alias("features"),
        F.col("label").cast("smallint").alias("label"),
        F.col("probability").cast("double").alias("probability"),
        created_at.alias("created_at"),
    )


def append_log(log: DataFrame, path: str) -> None:
    """Append to the log, partitioned by day so that windows prune old files.

    Rows of a day are brought together first: its files are as large as adaptive execution likes its partitions, however many
    tasks and days there are. A day with too many rows for one is split.
    """
    dated = log.withColumn("created_date", F.to_date("created_at"))
    dated.hint("rebalance", "created_date").write.mode("append").partitionBy("created_date").parquet(path)


def expand_log(log: DataFrame, schema: StructType, keep: Sequence[str] = ("label",)) -> DataFrame:
    """Features as columns, label appended. JSON text is parsed, a struct is taken as it is.

    Keys missing from a row become NULL.
    """
    kind = log.schema["features"].dataType
    is_text = isinstance(kind, StringType)
    parsed = F.from_json("features", schema) if is_text else F.col("features")
    have = set(schema.names if is_text else kind.fieldNames())
    fields = [(parsed.getField(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return log.select(*fields, *keep)


def rolling_window(
    df: DataFrame, n: int = WINDOW, order_col: str = "created_at", tie: Sequence[str] = ("id",), keys: Sequence[str] = ()
) -> DataFrame:
    """The last ``n`` rows by ``order_col`` (per key). Late rows are simply ranked by their time."""
    order = [F.col(order_col).desc(), *[F.col(t).desc() for t in tie]]
    return top_n_per_key(df, keys, order, n)
