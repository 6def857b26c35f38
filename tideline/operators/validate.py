"""Row rules with quarantine, category allow-lists, contract checks, batch outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tideline.functions.severity import SEVERITIES
from tideline.operators.features import PAYLOAD_FIELDS
from tideline.operators.profile import long_categorical, present


@dataclass(frozen=True)
class Rule:
    """A named condition that marks a row as bad."""

    name: str
    bad: Column


def required(column: str) -> Rule:
    return Rule(f"{column}:required", F.col(column).isNull())


def in_range(column: str, low: float | None = None, high: float | None = None) -> Rule:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return Rule(f"{column}:range", bad)


def one_of(column: str, values: Sequence[str]) -> Rule:
    return Rule(f"{column}:value", ~F.col(column).isin(*values))


def min_length(column: str, length: int = 1) -> Rule:
    return Rule(f"{column}:length", F.length(column) < length)


def every(column: str, field: str, ok) -> Rule:
    """All elements of an array of structs satisfy ``ok(element.field)``."""
    return Rule(f"{column}.{field}:value", ~F.forall(column, lambda e: F.coalesce(ok(e[field]), F.lit(False))))


def serving_rules() -> list[Rule]:
    rules = [required(c) for c in PAYLOAD_FIELDS]
    return [*rules, in_range("age", 18, 100), in_range("campaign", 1), in_range("previous", 0)]


# Closed literals and ranges of the strict schema.
STRICT_VALUES = {
    "job": ("admin.", "blue-collar", "entrepreneur", "housemaid", "management", "retired", "self-employed", "services", "student", "technician", "unemployed", "unknown"),
    "marital": ("divorced", "married", "single", "unknown"),
    "education": ("basic.4y", "basic.6y", "basic.9y", "high.school", "illiterate", "professional.course", "university.degree", "unknown"),
    "default": ("no", "yes", "unknown"),
    "housing": ("no", "yes", "unknown"),
    "loan": ("no", "yes", "unknown"),
    "contact": ("cellular", "telephone"),
    "month": ("mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    "day_of_week": ("mon", "tue", "wed", "thu", "fri"),
    "poutcome": ("failure", "nonexistent", "success"),
}
STRICT_RANGES = {
    "age": (17, 100), "campaign": (1, 100), "pdays": (0, 999), "previous": (0, 20),
    "emp_var_rate": (-10, 10), "cons_price_idx": (80, 110), "cons_conf_idx": (-100, 0),
    "euribor3m": (0, 10), "nr_employed": (4000, 6000),
}


def strict_rules() -> list[Rule]:
    rules = [required(c) for c in PAYLOAD_FIELDS]
    rules += [one_of(c, v) for c, v in STRICT_VALUES.items()]
    return rules + [in_range(c, lo, hi) for c, (lo, hi) in STRICT_RANGES.items()]


def trim_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c, t in df.dtypes if t == "string"})


def extra_columns(df: DataFrame, allowed: Sequence[str]) -> list[str]:
    """Columns a strict schema does not know, in name order."""
    return sorted(set(df.columns) - set(allowed))


# Fields of the contracts, version v1; a mapping is a struct, a list of one mapping an array of structs.
ALERT_EVENT_FIELDS = {
    "schema_version": None, "event_id": None, "report_id": None, "previous_severity": None, "model_name": None,
    "model_version": None, "severity": None, "created_at": None,
    "drift_summary": {"text": None, "window_size": None, "output_drift_severity": None},
    "top_features": [{"feature": None, "metric": None, "value": None, "severity": None}],
    "psi_results": [{"feature": None, "psi": None, "severity": None}],
    "chi2_results": [{"feature": None, "statistic": None, "p_value": None, "severity": None}],
    "output_drift": {"psi": None, "severity": None},
    "window_size": None,
}
PROMOTION_REQUEST_FIELDS = {"model_name": None, "target_version": None, "investigation_id": None, "hil_approval_id": None}


def extra_fields(schema: StructType, contract: Mapping) -> list[str]:
    """Paths of fields that a strict contract does not know, at any depth (``a.b``; ``a[].b`` inside arrays), in order."""
    found = []
    for field in schema:
        if field.name not in contract:
            found.append(field.name)
            continue
        inside, kind, path = contract[field.name], field.dataType, f"{field.name}."
        if isinstance(inside, list) and isinstance(kind, ArrayType):
            inside, kind, path = inside[0], kind.elementType, f"{field.name}[]."
        if isinstance(inside, Mapping) and isinstance(kind, StructType):
            found += [path + name for name in extra_fields(kind, inside)]
    return sorted(found)


def extra_json_fields(text: Column, contract: Mapping) -> Column:
    """The same for JSON objects in a text column, row by row: names of unknown fields of the object and of its structs.

    An empty array where the text is null or no object. Elements of arrays are looked into one by one; a path counts once.
    """
    nothing = F.array().cast("array<string>")

    def unknown(value: Column, known: Mapping) -> Column:
        return F.array_except(F.coalesce(F.json_object_keys(value), nothing), F.array(*map(F.lit, known)))

    def under(path: str, names: Column) -> Column:
        return F.transform(names, lambda k: F.concat(F.lit(path), k))

    def inside_elements(value: Column, known: Mapping) -> Column:
        elements = F.coalesce(F.from_json(value, "array<string>"), nothing)
        return F.flatten(F.transform(elements, lambda e: unknown(e, known)))

    parts = [unknown(text, contract)]
    for name, inside in contract.items():
        value = F.get_json_object(text, f"$.{name}")
        if isinstance(inside, Mapping):
            parts.append(under(f"{name}.", unknown(value, inside)))
        elif isinstance(inside, list):
            parts.append(under(f"{name}[].", inside_elements(value, inside[0])))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def alert_event_rules() -> list[Rule]:
    """Contract of an alert event, version v1."""
    level = lambda c: c.isin(*SEVERITIES)
    return [
        required("schema_version"), one_of("schema_version", ("v1",)),
        required("event_id"), min_length("event_id"),
        required("report_id"), min_length("report_id"),
        one_of("previous_severity", SEVERITIES),
        required("model_name"), min_length("model_name"),
        required("model_version"), in_range("model_version", 1),
        required("severity"), one_of("severity", SEVERITIES),
        required("created_at"),
        Rule("drift_summary:value", F.coalesce((F.length("drift_summary.text") < 1) | (F.col("drift_summary.window_size") < 0) | ~level(F.col("drift_summary.output_drift_severity")), F.lit(True))),
        required("top_features"),
        every("top_features", "feature", lambda v: v.isNotNull()),
        every("top_features", "metric", lambda v: v.isin("psi", "chi2")),
        every("top_features", "value", lambda v: v >= 0),
        every("top_features", "severity", level),
        required("psi_results"),
        every("psi_results", "feature", lambda v: v.isNotNull()),
        every("psi_results", "psi", lambda v: v >= 0),
        every("psi_results", "severity", level),
        required("chi2_results"),
        every("chi2_results", "feature", lambda v: v.isNotNull()),
        every("chi2_results", "statistic", lambda v: v >= 0),
        every("chi2_results", "p_value", lambda v: v.between(0, 1)),
        every("chi2_results", "severity", level),
        Rule("output_drift:value", F.coalesce((F.col("output_drift.psi") < 0) | ~level(F.col("output_drift.severity")), F.lit(True))),
        required("window_size"), in_range("window_size", 0),
    ]


def promotion_request_rules() -> list[Rule]:
    texts = ("model_name", "investigation_id", "hil_approval_id")
    return [r for c in texts for r in (required(c), min_length(c))] + [required("target_version"), in_range("target_version", 1)]


def check(df: DataFrame, rules: Sequence[Rule], out: str = "violations") -> DataFrame:
    """Add the names of all broken rules, in rule order."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(r.bad, F.lit(r.name)) for r in rules])))


def validate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``violations``)."""
    checked = check(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def allowed_categories(source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column: ``feature, category``."""
    return long_categorical(source, columns).where(F.col("category").isNotNull()).distinct()


def unseen_categories(batch: DataFrame, allowed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Observed values that the allow-list lacks, for columns the list knows."""
    known = allowed.select("feature").distinct()
    observed = allowed_categories(batch, present(batch, columns))
    return observed.join(known, "feature", "left_semi").join(allowed, ["feature", "category"], "left_anti")


def unseen_category_rows(batch: DataFrame, allowed: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Row-level form: ids, feature and the value the allow-list lacks."""
    return (
        long_categorical(batch, columns, ids)
        .where(F.col("category").isNotNull())
        .join(allowed, ["feature", "category"], "left_anti")
        .select(*ids, "feature", "category")
    )


def require_known_categories(batch: DataFrame, allowed: DataFrame, columns: Sequence[str]) -> None:
    """Raise if a batch brings values the allow-list lacks; the error has the first value of each column
    and the number of others. :func:`unseen_categories` has them all, however many there are.
    """
    found = unseen_categories(batch, allowed, columns).groupBy("feature").agg(F.min("category").alias("first"), F.count(F.lit(1)).alias("n"))
    bad = found.orderBy("feature").collect()
    if bad:
        raise ValueError("invalid categories: " + ", ".join(f"{r['feature']}={r['first']}" + (f" and {r['n'] - 1} more" if r["n"] > 1 else "") for r in bad))


def batch_outcome(checked: DataFrame, order: Sequence[str], examples: int = 5) -> DataFrame:
    """One row: counts of good and bad rows and the first few errors in ``order``."""
    bad = F.size("violations") > 0
    counts = checked.agg(F.count_if(~bad).alias("success_count"), F.count_if(bad).alias("failure_count"))
    text = F.concat_ws(" ", F.concat_ws("/", *order), F.array_join("violations", ","))
    first = (
        checked.where(bad)
        .select(*order, text.alias("error"))
        .orderBy(*order, "error")
        .limit(examples)
        .agg(F.sort_array(F.collect_list(F.struct(*order, "error"))).alias("e"))
        .select(F.transform("e", lambda e: e["error"]).alias("errors"))
    )
    return counts.join(F.broadcast(first), F.lit(True))  # two single rows


def outcome_exit_code(success: Column, failure: Column) -> Column:
    """2 if nothing succeeded, 1 if something failed, else 0."""
    return F.when((success == 0) & (failure > 0), 2).when(failure > 0, 1).otherwise(0)


def investigation_counts(investigations: DataFrame) -> DataFrame:
    state = F.when(F.col("status") == "resolved", "resolved").otherwise("open")
    return investigations.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def field_types(mapping: Mapping[str, str] = PAYLOAD_FIELDS) -> str:
    """DDL string of a payload schema."""
    return ", ".join(f"`{n}` {k}" for n, k in mapping.items())
