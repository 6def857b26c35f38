"""Controlled drift: ordered column changes that keep values inside the range of a source table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.hashrank import band_column, hash_limits
from tideline.operators.profile import long_numeric, present
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.sampling import SEED, class_conditional_sample, sample


@dataclass(frozen=True)
class Shift:
    """Add ``delta``, clip to the source range."""

    column: str
    delta: float


@dataclass(frozen=True)
class AtQuantile:
    """Set the whole column to a source quantile."""

    column: str
    q: float


@dataclass(frozen=True)
class LowSentinel:
    """Set the column to the lower quartile of its non-sentinel source values."""

    column: str
    sentinel: int = 999


@dataclass(frozen=True)
class Fraction:
    """Set a share of rows to a value, if the source knows it."""

    column: str
    value: str
    share: float


Step = Shift | AtQuantile | LowSentinel | Fraction

# The four scenario programs, in order of application.
SCENARIOS: dict[str, tuple[Step, ...]] = {
    "normal": (),
    "replay_drift": (
        Shift("euribor3m", 0.35),
        Shift("cons_price_idx", 0.08),
        Fraction("contact", "telephone", 0.35),
        Fraction("month", "nov", 0.25),
        Fraction("job", "technician", 0.20),
    ),
    "retrain_drift": (
        Shift("euribor3m", 1.25),
        Shift("emp_var_rate", 1.20),
        Shift("cons_price_idx", 0.35),
        Shift("nr_employed", 90.0),
        Fraction("contact", "telephone", 0.70),
        Fraction("month", "may", 0.65),
        Fraction("poutcome", "nonexistent", 0.80),
        Fraction("job", "blue-collar", 0.45),
    ),
    "rollback_drift": (
        AtQuantile("euribor3m", 0.02),
        AtQuantile("emp_var_rate", 0.02),
        AtQuantile("nr_employed", 0.02),
        AtQuantile("cons_price_idx", 0.98),
        AtQuantile("previous", 0.98),
        AtQuantile("campaign", 0.05),
        LowSentinel("pdays"),
        Fraction("contact", "cellular", 0.95),
        Fraction("month", "mar", 0.45),
        Fraction("month", "oct", 0.30),
        Fraction("poutcome", "success", 0.80),
        Fraction("job", "retired", 0.50),
        Fraction("job", "student", 0.25),
    ),
}


def source_range(source: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and greatest numeric value of some columns, in one scan."""
    columns = present(source, columns)
    if not columns:
        return {}
    as_number = {c: F.col(c).try_cast("double") for c in columns}
    row = source.agg(*[f(as_number[c]).alias(f"{c}_{i}") for c in columns for i, f in enumerate((F.min, F.max))]).first()
    return {c: (row[f"{c}_0"], row[f"{c}_1"]) for c in columns}


def source_quantiles(source: DataFrame, wanted: Sequence[tuple[str, float]]) -> dict[tuple[str, float], float]:
    """Exact interpolated quantiles of some columns, one search for all of them."""
    columns = present(source, list(dict.fromkeys(c for c, _ in wanted)))
    if not columns:
        return {}
    probs = sorted({q for _, q in wanted})
    numbers = source.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    rows = exact_quantiles(long_numeric(numbers, columns), probs).collect()  # one row per column
    return {(r["feature"], q): v for r in rows for q, v in zip(probs, r["quantiles"])}


def known_values(source: DataFrame, wanted: Sequence[tuple[str, str]]) -> set[tuple[str, str]]:
    """Which (column, value) pairs occur in a table, in one scan."""
    wanted = [w for w in dict.fromkeys(wanted) if w[0] in source.columns]
    if not wanted:
        return set()
    row = source.agg(*[F.coalesce(F.bool_or(F.col(c).cast("string") == v), F.lit(False)) for c, v in wanted]).first()
    return {w for w, seen in zip(wanted, row) if seen}


def _clipped(column: str, delta: float, low: float, high: float) -> Column:
    moved = F.col(column).try_cast("double") + F.lit(delta)
    return F.when(moved.isNotNull(), F.greatest(F.least(moved, F.lit(high)), F.lit(low)))


def _low_sentinel(source: DataFrame, step: LowSentinel) -> int:
    value = source_quantiles(source.where(F.col(step.column).try_cast("double") < step.sentinel), [(step.column, 0.25)])
    return int(value[step.column, 0.25]) if value else step.sentinel


def apply_steps(
    df: DataFrame, source: DataFrame, steps: Sequence[Step], ids: Sequence[str], seed: int | str = SEED
) -> DataFrame:
    """Fold a program over a table. The loop runs over step definitions, never over rows.

    Everything the steps need from ``source`` is read first (one scan per kind of step), as are the
    hash limits of all fraction steps; the changes themselves are plain column expressions. The n-th
    fraction step draws with its own seed from ``ids``, which no step may change.
    """
    steps = [s for s in steps if s.column in df.columns and s.column in source.columns]
    ranges = source_range(source, list(dict.fromkeys(s.column for s in steps if isinstance(s, Shift))))
    quantiles = source_quantiles(source, [(s.column, s.q) for s in steps if isinstance(s, AtQuantile)])
    known = known_values(source, [(s.column, s.value) for s in steps if isinstance(s, Fraction)])
    fractions = [s for s in steps if isinstance(s, Fraction)]
    drawn = {i: s for i, s in enumerate(fractions, 1) if (s.column, s.value) in known}
    cuts = {f"{seed}.{i}": [F.greatest(F.floor(F.col("n") * F.lit(s.share)), F.lit(1))] for i, s in drawn.items()}
    limits = hash_limits(df, ids, cuts) if cuts else {}
    draw = 0
    for step in steps:
        if isinstance(step, Shift):
            df = df.withColumn(step.column, _clipped(step.column, step.delta, *ranges[step.column]))
        elif isinstance(step, AtQuantile):
            df = df.withColumn(step.column, F.lit(quantiles.get((step.column, step.q))).cast("double"))
        elif isinstance(step, LowSentinel):
            df = df.withColumn(step.column, F.lit(_low_sentinel(source, step)))
        else:
            draw += 1
            if draw in drawn:
                chosen = band_column(ids, f"{seed}.{draw}", limits[f"{seed}.{draw}"]) == 0
                df = df.withColumn(step.column, F.when(chosen, F.lit(step.value)).otherwise(F.col(step.column)))
    return df


def shift_clip(df: DataFrame, source: DataFrame, column: str, delta: float) -> DataFrame:
    return apply_steps(df, source, [Shift(column, delta)], [])


def set_quantile(df: DataFrame, source: DataFrame, column: str, q: float) -> DataFrame:
    return apply_steps(df, source, [AtQuantile(column, q)], [])


def replace_sentinel(df: DataFrame, source: DataFrame, column: str = "pdays", sentinel: int = 999) -> DataFrame:
    return apply_steps(df, source, [LowSentinel(column, sentinel)], [])


def apply_scenario(
    df: DataFrame, source: DataFrame, scenario: str, ids: Sequence[str], seed: int | str = SEED
) -> DataFrame:
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario: {scenario}")
    return apply_steps(df, source, SCENARIOS[scenario], ids, seed)


def scenario_batch(
    source: DataFrame, scenario: str, rows: int, ids: Sequence[str], positive: Column | None = None, seed: int = SEED
) -> DataFrame:
    """A batch of exactly ``rows`` rows under a scenario; the rollback one starts from positives.

    The result names its draws in ``draw`` where rows were drawn with replacement.
    """
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario: {scenario}")
    offset = list(SCENARIOS).index(scenario)
    if scenario == "rollback_drift" and positive is not None:
        base = class_conditional_sample(source, rows, positive, ids, seed + offset)
    else:
        base = sample(source, rows, ids, seed + offset)
    return apply_scenario(base, source, scenario, ids, seed + offset)


def generate_batches(
    source: DataFrame, path: str, rows: int, ids: Sequence[str], positive: Column | None = None, seed: int = SEED
) -> DataFrame:
    """Write one comma-separated batch per scenario and return them with a ``scenario`` column."""
    for scenario in SCENARIOS:
        batch = scenario_batch(source, scenario, rows, ids, positive, seed)
        batch.write.mode("overwrite").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/scenario={scenario}")
    return source.sparkSession.read.option("header", True).csv(path)


def inject_shifted_rows(
    rows: DataFrame,
    index_col: str,
    base: Mapping[str, object],
    feature: str,
    shift: float,
    other: tuple[str, str] = ("job", "retired"),
    label: int = 1,
    probability: float = 0.85,
) -> DataFrame:
    """One constant log row per input row: ``feature`` shifted, every tenth row of another category."""
    values = dict(base)
    if isinstance(values.get(feature), (int, float)):
        values[feature] = float(values[feature]) + shift
    columns = {name: F.lit(v) for name, v in values.items()}
    column, value = other
    columns[column] = F.when(F.col(index_col) % 10 == 0, F.lit(value)).otherwise(F.lit(values.get(column)))
    return rows.select(
        index_col,
        *[c.alias(n) for n, c in columns.items()],
        F.lit(label).cast("smallint").alias("label"),
        F.lit(probability).alias("probability"),
    )
