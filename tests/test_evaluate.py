import numpy as np
import pandas as pd
import pytest

from tideline.operators import evaluate as M

RNG = np.random.default_rng(5)
N = 1200


@pytest.fixture(scope="module")
def data():
    y = RNG.integers(0, 2, N)
    score = np.round(np.clip(0.3 * y + RNG.uniform(size=N) * 0.7, 0, 1), 2)  # many ties
    score[: N // 3] = 0.5  # a third of all rows share one score
    return pd.DataFrame({"id": np.arange(N), "k": RNG.choice(["a", "b"], N), "s": score, "y": y})


def brute_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def brute_curve(s, y):
    rows = []
    for t in np.unique(s):
        hit = s >= t
        precision, recall = y[hit].mean(), y[hit].sum() / y.sum()
        rows.append((t, precision, recall, 2 * precision * recall / max(precision + recall, 1e-300)))
    return rows


def test_auc_with_ties(spark, data):
    df = spark.createDataFrame(data)
    assert M.roc_auc(df, "s", "y", buckets=5).first()["roc_auc"] == pytest.approx(brute_auc(data["s"].values, data["y"].values))
    for r in M.roc_auc(df, "s", "y", ["k"]).collect():
        part = data[data["k"] == r["k"]]
        assert r["roc_auc"] == pytest.approx(brute_auc(part["s"].values, part["y"].values))


def test_auc_of_one_class_is_null(spark):
    assert M.roc_auc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int"), "s", "y").first()["roc_auc"] is None


def test_curve_and_thresholds(spark, data):
    df = spark.createDataFrame(data)
    want = brute_curve(data["s"].values, data["y"].values)
    got = sorted(tuple(r) for r in M.pr_curve(df, "s", "y").collect())
    np.testing.assert_allclose(got, want, rtol=1e-12)
    row = M.operating_threshold(df, "s", "y").first()
    assert row["operating_threshold"] == max(t for t, _, recall, _ in want if recall >= 0.75)
    best = max(f for *_, f in want)
    assert row["f1_optimal"] == min(t for t, *_, f in want if np.isclose(f, best, rtol=1e-12))
    assert M.operating_threshold(df, "s", "y", min_recall=1.1).first()["operating_threshold"] == row["f1_optimal"]


def test_confusion_metrics_and_undefined_ratios(spark, data):
    df = spark.createDataFrame(data)
    row = M.confusion_metrics(df, "s", "y", 0.5).first()
    hit, y = data["s"] >= 0.5, data["y"] == 1
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == ((hit & y).sum(), (hit & ~y).sum(), (~hit & y).sum(), (~hit & ~y).sum())
    none = M.confusion_metrics(df, "s", "y", 2.0).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_difference_of_scorings(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id int, probability double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.75)], "id int, probability double")
    assert tuple(M.max_abs_diff(a, a, ["id"]).first()) == (2, 0, 0.0, True)
    assert tuple(M.max_abs_diff(a, b, ["id"]).first()) == (2, 0, 0.5, False)
    assert not M.max_abs_diff(a, b.where("id = 1"), ["id"]).first()["within"]


def test_first_candidate_wins_ties(spark):
    df = spark.createDataFrame([(0, "dummy", 0.2), (1, "lr", 0.7), (2, "rf", 0.7)], "ordinal int, candidate string, val_f1 double")
    assert M.select_best_candidate(df).first()["candidate"] == "lr"
