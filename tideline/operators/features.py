"""Column work before scoring: leakage, sentinels, targets, projections, parsing, thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The scored table of the reference setting, names with "_" in place of ".".
NUMERIC_FEATURES = (
    "age", "campaign", "pdays", "previous", "emp_var_rate", "cons_price_idx",
    "cons_conf_idx", "euribor3m", "nr_employed", "pdays_was_999",
)
CATEGORICAL_FEATURES = (
    "job", "marital", "education", "default", "housing", "loan", "contact", "month", "day_of_week", "poutcome",
)
PAYLOAD_FIELDS = {
    "age": "int", "job": "string", "marital": "string", "education": "string", "default": "string",
    "housing": "string", "loan": "string", "contact": "string", "month": "string", "day_of_week": "string",
    "campaign": "int", "pdays": "int", "previous": "int", "poutcome": "string", "emp_var_rate": "double",
    "cons_price_idx": "double", "cons_conf_idx": "double", "euribor3m": "double", "nr_employed": "double",
}
LEAKAGE = ("duration",)
SENTINEL = 999
TARGET = {"no": 0, "yes": 1}


def normalise_names(df: DataFrame) -> DataFrame:
    """``emp.var.rate`` -> ``emp_var_rate``; dots would otherwise need quoting everywhere."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


def drop_leakage(df: DataFrame, columns: Sequence[str] = LEAKAGE) -> DataFrame:
    return df.drop(*columns)


def sentinel_flag(df: DataFrame, column: str = "pdays", sentinel: int = SENTINEL, out: str = "pdays_was_999") -> DataFrame:
    return df.withColumn(out, (F.col(column) == sentinel).cast("int"))


def map_target(df: DataFrame, column: str = "y", mapping: Mapping[str, int] = TARGET, out: str | None = None) -> DataFrame:
    """Class number of a label text; unknown texts become NULL."""
    value = F.lit(None).cast("int")
    for text, number in mapping.items():
        value = F.when(F.col(column) == text, F.lit(number)).otherwise(value)
    return df.withColumn(out or column, value)


def prepare_features(df: DataFrame) -> DataFrame:
    return map_target(sentinel_flag(drop_leakage(df)))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles where a text parses, NULL where it does not."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def payload_checks(df: DataFrame, fields: Mapping[str, str] = PAYLOAD_FIELDS) -> Column:
    """Names of the fields a row cannot supply: missing, NULL, or not a number."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {missing}")
    bad = []
    for name, kind in fields.items():
        value = F.col(name) if kind == "string" else F.col(name).try_cast("double")
        bad.append(F.when(value.isNull(), F.lit(name)))
    return F.array_compact(F.array(*bad))


def project_payload(df: DataFrame, fields: Mapping[str, str] = PAYLOAD_FIELDS, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with exactly ``fields`` in order, rejected rows with ``bad_fields``)."""
    checked = df.withColumn("bad_fields", payload_checks(df, fields))
    casts = {
        "string": lambda c: c.cast("string"),
        "double": lambda c: c.try_cast("double"),
        "int": lambda c: c.try_cast("double").cast("int"),
    }
    accepted = checked.where(F.size("bad_fields") == 0).select(*keep, *[casts[k](F.col(n)).alias(n) for n, k in fields.items()])
    return accepted, checked.where(F.size("bad_fields") > 0)


def threshold_label(probability: Column, threshold: float | Column) -> Column:
    """1 iff probability >= threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (probability >= limit).cast("int")
