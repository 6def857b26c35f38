import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import quantiles
from tideline.operators.profile import bin_counts, bin_of, long_numeric, numeric_profile
from tideline.operators.quantiles import exact_quantiles

RNG = np.random.default_rng(7)
SHAPES = {
    "normal": RNG.normal(size=1500),
    "ties": RNG.integers(0, 4, 1500).astype(float),
    "constant": np.full(1500, 3.5),
    "heavy": np.exp(RNG.normal(0, 15, 1500)),
    "outliers": np.concatenate([RNG.uniform(size=1497), [1e300, -1e300, 1e100]]),
    "hot": np.where(RNG.uniform(size=1500) < 0.4, 1.0, RNG.uniform(size=1500)),
    "missing": np.where(RNG.uniform(size=1500) < 0.3, np.nan, RNG.normal(size=1500)),
}
PROBS = [0.0, 0.1, 0.25, 0.5, 0.731, 0.9, 1.0]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(pd.DataFrame(SHAPES))


@pytest.mark.parametrize("bins,sorted_rows", [(2048, 20_000), (64, 20)])
def test_quantiles_equal_numpy(frame, bins, sorted_rows):
    rows = exact_quantiles(long_numeric(frame, list(SHAPES)), PROBS, bins=bins, sorted_rows=sorted_rows).collect()
    found = {r["feature"]: r["quantiles"] for r in rows}
    for name, values in SHAPES.items():
        np.testing.assert_allclose(found[name], np.nanquantile(values, PROBS), rtol=1e-12, err_msg=name)


def test_quantiles_per_key_with_a_hot_key(spark):
    key = np.where(RNG.uniform(size=3000) < 0.6, "hot", RNG.choice(list("abc"), 3000))
    value = RNG.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"k": key, "value": value}))
    rows = exact_quantiles(df, [0.1, 0.5, 0.9], ["k"], bins=64, sorted_rows=50).collect()
    assert len(rows) == len(set(key))
    for r in rows:
        np.testing.assert_allclose(r["quantiles"], np.quantile(value[key == r["k"]], [0.1, 0.5, 0.9]), rtol=1e-12)


@pytest.mark.parametrize("wrong", ["same", "crossed"])
def test_wrong_brackets_cost_passes_only(frame, monkeypatch, wrong):
    values = {"same": lambda p: (1.0, 1.0), "crossed": lambda p: (2.0 - p, p - 2.0)}

    def brackets(sketch, n, probs):
        pairs = [values[wrong](p) for p in probs]
        return F.array(*[F.lit(a) for a, _ in pairs], *[F.lit(b) for _, b in pairs])

    monkeypatch.setattr(quantiles, "brackets", brackets)
    rows = exact_quantiles(long_numeric(frame, list(SHAPES)), PROBS, bins=64, sorted_rows=20).collect()
    for r in rows:
        np.testing.assert_allclose(r["quantiles"], np.nanquantile(SHAPES[r["feature"]], PROBS), rtol=1e-12, err_msg=r["feature"])


def test_brackets_leave_few_rows_after_one_scan(spark, monkeypatch):
    """Columns whose rows crowd in a tiny part of their range need one counting scan, then the last sort."""
    df = spark.range(400_000).select(
        F.exp(F.randn(3) * 8).alias("heavy"), F.when(F.rand(4) < 0.4, 7.0).otherwise(F.rand(5) * 1e-9).alias("hot")
    )
    steps = []
    monkeypatch.setattr(quantiles, "cut", lambda d, cut=quantiles.cut: steps.append(cut(d)) or steps[-1])
    stored = quantiles.cut(df)
    found = {r["feature"]: r["quantiles"] for r in exact_quantiles(long_numeric(stored, df.columns), [0.1, 0.5, 0.9], sorted_rows=5_000).collect()}
    assert len(steps) == 3  # the rows themselves, the bounds, one scan of counts
    for name in df.columns:
        np.testing.assert_allclose(found[name], np.quantile([r[0] for r in stored.select(name).collect()], [0.1, 0.5, 0.9]), rtol=1e-12)


def test_infinities_are_ordered(spark):
    values = [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "value double").withColumn("feature", F.lit("f"))
    row = exact_quantiles(df, [0.25, 0.5, 0.75], bins=4, sorted_rows=1).first()
    assert row["quantiles"] == [1.0, 2.0, 3.0]


def test_all_missing_column_gives_null_arrays(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "a double, b double")
    rows = {r["feature"]: r for r in numeric_profile(df, ["a", "b"]).collect()}
    assert rows["a"]["n"] == 2 and rows["a"]["edges"] is None
    assert rows["b"]["n"] == 2 and len(rows["b"]["edges"]) == 9


def test_bins_equal_numpy_histogram_with_duplicate_edges(spark):
    values = RNG.integers(0, 5, 400).astype(float)
    edges = np.quantile(values, np.linspace(0, 1, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    want, _ = np.histogram(values, bins=edges)
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    got = df.agg(bin_counts(bin_of(F.col("value"), inner, 10), 10).alias("c")).first()["c"]
    assert got == want.tolist()
