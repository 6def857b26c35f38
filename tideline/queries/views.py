"""The given tables mapped to the concepts of the engine, in Spark and in SQL.

``lineitem`` is the scored table: rows shipped before the split date are the reference, later rows the
current window. The generated data are stationary, so the current side is shifted by fixed rules to
reach all severities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "1998-05-24"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reference(spark: SparkSession, sf: str) -> DataFrame:
    """Scored reference rows with the predicted class ``label``."""
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz"))
        .withColumn("label", (F.col("l_extendedprice") / 110000 >= 0.5).cast("int"))
    )


def current(spark: SparkSession, sf: str) -> DataFrame:
    """Scored current rows: shifted quantity, more 'N' flags, missing discounts, more positives."""
    return (
        table(spark, sf, "lineitem")
        .where(F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz"))
        .select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.least(F.col("l_quantity") + 15, F.lit(50.0)).alias("l_quantity"),
            "l_extendedprice",
            F.when(F.col("l_tax") < 0.08, F.col("l_discount")).alias("l_discount"),
            "l_tax",
            F.when(F.col("l_linenumber") <= 2, "N").when(F.col("l_linenumber") == 7, "X").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
            "l_linestatus",
            "l_shipdate",
            (F.col("l_extendedprice") / 110000 >= 0.35).cast("int").alias("label"),
            F.year("l_shipdate").alias("segment"),
        )
    )


REF = f"""ref AS (
  SELECT *, CAST(l_extendedprice / 110000 >= 0.5 AS INTEGER) AS label
  FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT} 00:00:00')"""

CUR = f"""cur AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, least(l_quantity + 15, 50.0) AS l_quantity,
    l_extendedprice, CASE WHEN l_tax < 0.08 THEN l_discount END AS l_discount, l_tax,
    CASE WHEN l_linenumber <= 2 THEN 'N' WHEN l_linenumber = 7 THEN 'X' ELSE l_returnflag END AS l_returnflag,
    l_linestatus, l_shipdate, CAST(l_extendedprice / 110000 >= 0.35 AS INTEGER) AS label,
    CAST(year(l_shipdate) AS INTEGER) AS segment
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT} 00:00:00')"""


def long_sql(source: str, features: list[str], cast: str, keys: str = "") -> str:
    """Long form of some columns: keys, feature, value."""
    keys = f"{keys}, " if keys else ""
    return "\n    UNION ALL ".join(
        f"SELECT {keys}'{f}' AS feature, CAST({f} AS {cast}) AS value FROM {source}" for f in features
    )
