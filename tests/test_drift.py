import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions.stats import chi2_upper_tail
from tideline.operators import drift as D
from tideline.operators import profile as P


def brute_psi(ref, cur, bins=10, eps=1e-8):
    edges = np.nanquantile(ref, np.linspace(0, 1, bins + 1))
    edges[0], edges[-1] = -np.inf, np.inf
    shares = []
    for side in (ref, cur):
        counts, _ = np.histogram(side[~np.isnan(side)], bins=edges)
        shares.append(counts / (counts.sum() + eps) + eps)
    r, c = shares
    return float(((c - r) * np.log(c / r)).sum())


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


RNG = np.random.default_rng(42)
BASE = RNG.normal(0, 1, 1000)


@pytest.mark.parametrize(
    "current,low,high,severity",
    [
        (BASE, 0.0, 0.01, "low"),
        (RNG.normal(5, 1, 500), 0.25, 1e9, "high"),
        (RNG.normal(0.4, 1, 500), 0.05, 0.5, None),
    ],
)
def test_psi_on_known_shifts(spark, current, low, high, severity):
    profile = P.numeric_profile(frame(spark, x=BASE), ["x"])
    row = D.psi(profile, frame(spark, x=current), ["x"]).first()
    assert low <= row["psi"] <= high
    assert row["psi"] == pytest.approx(brute_psi(BASE, current), rel=1e-9, abs=1e-12)
    assert severity is None or row["severity"] == severity
    assert (row["reference_n"], row["current_n"]) == (1000, len(current))


def test_psi_with_ties_missing_values_and_keys(spark):
    ref = {"a": RNG.integers(0, 6, 800).astype(float), "b": RNG.exponential(1, 800)}
    key = np.where(RNG.uniform(size=900) < 0.5, "hot", RNG.choice(list("xyz"), 900))
    cur = {"a": RNG.integers(0, 8, 900).astype(float), "b": np.where(RNG.uniform(size=900) < 0.2, np.nan, RNG.exponential(2, 900))}
    profile = P.numeric_profile(frame(spark, **ref), ["a", "b"])
    rows = D.psi(profile, frame(spark, k=key, **cur), ["a", "b"], keys=["k"]).collect()
    assert len(rows) == 8
    for r in rows:
        part = cur[r["feature"]][key == r["k"]]
        assert r["psi"] == pytest.approx(brute_psi(ref[r["feature"]], part), rel=1e-9)
        assert r["current_n"] == len(part)


def test_psi_of_an_all_missing_column_is_high(spark):
    profile = P.numeric_profile(frame(spark, x=BASE), ["x"])
    row = D.psi(profile, frame(spark, x=np.full(50, np.nan)), ["x"]).first()
    assert row["severity"] == "high" and row["current_n"] == 50


def test_psi_strict_rejects_an_empty_side(spark):
    profile = P.numeric_profile(frame(spark, x=BASE), ["x"])
    with pytest.raises(ValueError):
        D.psi(profile, frame(spark, x=BASE).where("false"), ["x"], strict=True)


def test_per_key_reference(spark):
    key = np.repeat(["p", "q"], 500)
    ref = np.concatenate([RNG.normal(0, 1, 500), RNG.normal(10, 1, 500)])
    df = frame(spark, k=key, x=ref)
    profile = P.numeric_profile(df, ["x"], keys=["k"])
    rows = D.psi(profile, df, ["x"], keys=["k"], profile_keys=["k"]).collect()
    assert len(rows) == 2 and all(r["psi"] < 1e-9 for r in rows)


def chi2_of(spark, freqs, values, **kw):
    cat = spark.createDataFrame([("f", c, p) for c, p in freqs.items()], "feature string, category string, freq double")
    return D.chi2(cat, spark.createDataFrame([(v,) for v in values], "f string"), ["f"], **kw).first()


def test_chi2_keeps_missing_mass(spark):
    row = chi2_of(spark, {"a": 0.25, "b": 0.22, "c": 0.16}, ["a"] * 50 + ["b"] * 40 + ["c"] * 10)
    assert row["feature"] == "f" and row["current_n"] == 100 and row["dof"] == 2
    assert row["statistic"] == pytest.approx((50 - 25) ** 2 / 25 + (40 - 22) ** 2 / 22 + (10 - 16) ** 2 / 16)
    assert row["reference_n"] in (62, 63)


def test_chi2_balanced_shift_is_high(spark):
    row = chi2_of(spark, {"a": 0.5, "b": 0.5}, ["a"] * 90 + ["b"] * 10, alpha=0.01)
    assert row["statistic"] == pytest.approx(64) and row["dof"] == 1 and row["severity"] == "high"


def test_chi2_unseen_and_null_values_raise_expectations_only(spark):
    row = chi2_of(spark, {"a": 0.5, "b": 0.5}, ["a"] * 40 + ["b"] * 40 + ["new"] * 10 + [None] * 10)
    assert row["current_n"] == 100
    assert row["statistic"] == pytest.approx(2 * (40 - 50) ** 2 / 50)


def test_chi2_absent_category_and_single_category(spark):
    assert chi2_of(spark, {"a": 0.5, "b": 0.5}, ["a"] * 10)["statistic"] == pytest.approx(10)
    one = chi2_of(spark, {"a": 1.0}, ["a"] * 10)
    assert one["dof"] == 1 and one["p_value"] == 1.0


@pytest.mark.parametrize("dof,x,p", [(1, 3.841458820694124, 0.05), (2, 5.991464547107979, 0.05), (3, 7.814727903251179, 0.05), (10, 18.307038053275146, 0.05), (11, 19.67513757268249, 0.05)])
def test_upper_tail_at_critical_values(dof, x, p):
    assert chi2_upper_tail(x, dof) == pytest.approx(p, rel=1e-10)


def test_upper_tail_limits():
    assert chi2_upper_tail(0.0, 3) == 1.0
    assert chi2_upper_tail(1e6, 3) == 0.0
    assert 0.49 < chi2_upper_tail(100_000, 100_000) < 0.51


@pytest.mark.parametrize("rate", [0.0, 0.11, 0.5, 1.0])
@pytest.mark.parametrize("mode", ["proportions", "compat"])
def test_output_drift_modes(spark, rate, mode):
    labels = np.array([1] * 30 + [0] * 70)
    out = spark.createDataFrame([("0", 1 - rate), ("1", rate)], "class string, share double")
    row = D.output_drift(out, frame(spark, label=labels), F.col("label"), mode=mode).first()
    if mode == "compat":
        want = brute_psi(np.array([0.0] * 100 + [1.0] * int(rate * 100)), labels.astype(float), bins=2)
    else:
        r, c = np.array([1 - rate, rate]) + 1e-8, np.array([0.7, 0.3]) + 1e-8
        want = float(((c - r) * np.log(c / r)).sum())
    assert row["psi"] == pytest.approx(want, abs=1e-9)
    assert row["current_class_1_rate"] == pytest.approx(0.3) and row["current_n"] == 100


def _report(spark, current, **kw):
    ref = spark.createDataFrame([(float(i % 50), "a" if i % 2 else "b", i % 2) for i in range(400)], "x double, c string, label int")
    profile = P.reference_profile(ref, ["x", "absent"], ["c"], F.col("label"))
    return D.drift_report(profile, current, ["x", "absent"], ["c"], F.col("label"), **kw)


def test_report_of_an_empty_window_is_a_low_placeholder(spark):
    empty = spark.createDataFrame([], "x double, c string, label int")
    row = _report(spark, empty).first()
    assert (row["severity"], row["window_size"], row["psi_results"], row["chi2_results"]) == ("low", 0, [], [])
    assert row["output_drift"]["psi"] == 0.0 and row["output_drift"]["reference_class_1_rate"] == 0.5


def test_report_per_key_takes_the_highest_severity_and_lists_silent_keys(spark):
    rows = [("same", float(i % 50), "a" if i % 2 else "b", i % 2) for i in range(400)]
    rows += [("moved", float(i % 50) + 40, "a", i % 2) for i in range(400)]
    cur = spark.createDataFrame(rows, "k string, x double, c string, label int")
    keys = spark.createDataFrame([("same",), ("moved",), ("silent",)], "k string")
    report = {r["k"]: r for r in _report(spark, cur, keys=["k"], all_keys=keys).collect()}
    assert {k: r["severity"] for k, r in report.items()} == {"same": "low", "moved": "high", "silent": "low"}
    assert report["silent"]["window_size"] == 0
    single = D.psi(P.numeric_profile(cur.where("k='same'"), ["x"]), cur.where("k='moved'"), ["x"]).first()["psi"]
    assert report["moved"]["psi_results"][0]["psi"] == pytest.approx(single)
    assert report["moved"]["report_id"] != report["same"]["report_id"]


def test_rankings(spark):
    psi = spark.createDataFrame([("a", 0.3, "high"), ("b", 0.01, "low"), ("c", 0.2, "medium")], "feature string, psi double, severity string")
    chi2 = spark.createDataFrame([("d", 50.0, 0.0, "high"), ("e", 9.0, 0.005, "high")], "feature string, statistic double, p_value double, severity string")
    rows = D.metric_rows(psi, chi2)
    assert [r["feature"] for r in D.top_drifted_features(rows, limit=4).orderBy("rank").collect()] == ["d", "e", "a", "c"]
    assert [r["feature"] for r in D.top_features_dashboard(rows).orderBy("rank").collect()] == ["d", "e", "a"]
    # the historical ranking reads p = 0 as 1 and so puts the strongest test last in its severity
    assert [r["feature"] for r in D.top_features_dashboard(rows, compat=True).orderBy("rank").collect()] == ["e", "a", "d"]
    assert D.aggregate_severity(rows).first()["severity"] == "high"
    assert math.isclose(D.top_psi(psi, limit=1).first()["psi"], 0.3)


def test_chi2_equals_the_grid_formula_with_rare_and_absent_categories(spark):
    rng = np.random.default_rng(8)
    freqs = {"a": 0.5, "b": 0.3, "c": 0.2 - 3e-9, "d": 1e-9, "e": 1e-9, "f": 1e-12, "g": 0.0}
    values = rng.choice(["a", "b", "d", "f", "g", "zz", None], 400, p=[0.4, 0.3, 0.1, 0.05, 0.05, 0.05, 0.05]).tolist()
    row = chi2_of(spark, freqs, values)
    seen = {c: values.count(c) for c in freqs}
    e = {c: max(f * 400, 1e-8) for c, f in freqs.items()}
    want = sum((seen[c] - e[c]) ** 2 / e[c] for c in freqs)
    assert abs(row.statistic - want) <= 1e-9 * want and row.dof == 6 and row.current_n == 400
