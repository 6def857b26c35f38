import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tideline.operators import evaluate as M
from tideline.plans import extra_trees as X
from tideline.plans import packed as P
from tideline.plans import random_forest as R
from tideline.plans import training as N
from tideline.plans.extra_trees import ExtraTrees, ExtraTreesModel

ROWS, TREES = 120, 2


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=ROWS), rng.integers(0, 2, ROWS), np.full(ROWS, 7.0), rng.integers(0, 5, ROWS), *[rng.random(ROWS) < 0.1 for _ in range(64)]]).astype(float)
    x[:3, 0] = np.nan
    y = (np.nan_to_num(x[:, 0]) + x[:, 1] + rng.normal(size=ROWS) > 0.8).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(ROWS), "x": x.tolist(), "label": y, "weight": np.where(y > 0, 2.0, 1.0)}))
    return df.withColumn("features", array_to_vector("x")).repartition(3, "id").persist()


def nodes_of(model):
    ranges = lambda r: tuple("nan" if v != v else v for v in (*r["low"], *r["high"]))
    return sorted((r["tree"], r["node"], r["depth"], r["n"], r["weight"], r["positive"], ranges(r), r["feature"] if r["feature"] is not None else -1, r["threshold"] or 0.0) for r in model.nodes.collect())


def scores_of(model, frame):
    return {r["id"]: r["p"] for r in model.transform(frame).select("id", vector_to_array("probability")[1].alias("p")).collect()}


def test_trees_grown_whole_equal_those_of_levels_and_write_rows_once(frame, monkeypatch):
    """Three ways of growing and two of scoring: rows in one task, rows that meet below a node, whole levels."""
    tables, write = [], X.stored
    monkeypatch.setattr(X, "stored", lambda df, *a: tables.append(df) or write(df, *a))
    model = ExtraTrees(TREES, seed=5).fit(frame)
    assert len(tables) == 2  # rows and nodes; nothing for each tree
    tables.clear()
    scores = scores_of(model, frame)
    assert len(tables) == 2 and len(scores) == ROWS  # rows and their scores
    monkeypatch.setattr(P, "PACKED_BYTES", 0)
    want = nodes_of(model)
    for rows in (X.SUBTREE_ROWS, 70):
        monkeypatch.setattr(X, "SUBTREE_ROWS", rows)
        tables.clear()
        again = ExtraTrees(TREES, seed=5).fit(frame)
        assert len(tables) > 2 and nodes_of(again) == want
    other = scores_of(again, frame)
    assert all(abs(other[i] - p) < 1e-12 for i, p in scores.items())


def test_scores_do_not_depend_on_how_trees_and_rows_are_dealt(frame, monkeypatch):
    model = ExtraTrees(TREES, max_depth=4, seed=5).fit(frame)
    whole = scores_of(model, frame)
    monkeypatch.setattr(P, "TREES_BYTES", 1)  # a tree a task
    monkeypatch.setattr(P, "BLOCK_ROWS", 14)
    dealt = scores_of(model, frame.union(frame.where("id < 5")))
    assert dealt.keys() == whole.keys() and all(abs(dealt[i] - p) < 1e-12 for i, p in whole.items())
    assert model.transform(frame.where("false")).count() == 0


def test_a_layout_keeps_every_value():
    rng = np.random.default_rng(2)
    x = (rng.random((50, 131)) < 0.5).astype(float)
    x[:, [0, 70]] = rng.normal(size=(50, 2))
    layout = P.Layout.of(((x == 0) | (x == 1)).all(axis=0))
    assert layout.words == 3 and layout.numbers.tolist() == [0, 70]
    np.testing.assert_array_equal(layout.unpack(*layout.pack(x)), x)


def naive_tree(codes, label, weight, times, splits, deepest):
    """A tree with all features asked at every node, row by row, siblings of one class united: {node: (n, weight, positive, feature, split)}."""
    out = {}
    mass = lambda w, p: p * (w - p) / w if w else 0.0

    def grow(rows, node, depth):
        w, p = weight[rows].sum(), (weight * label)[rows].sum()
        best = (1e-12, None, None)
        if depth < deepest and 0 < p < w:
            for f in range(codes.shape[1]):
                for s in range(len(splits[f])):
                    left = rows[codes[rows, f] <= s]
                    if 0 < len(left) < len(rows):
                        lw, lp = weight[left].sum(), (weight * label)[left].sum()
                        gain = 2 * (mass(w, p) - mass(lw, lp) - mass(w - lw, p - lp)) / w
                        if gain > best[0] + 1e-12:
                            best = (gain, f, s)
        n, f, s = int(times[rows].sum()), best[1], best[2]
        if f is not None:
            kids = [grow(rows[codes[rows, f] <= s], 2 * node + 1, depth + 1), grow(rows[codes[rows, f] > s], 2 * node + 2, depth + 1)]
            if all(k[0] for k in kids) and kids[0][1] == kids[1][1]:
                out.pop(2 * node + 1), out.pop(2 * node + 2)
                f = None
        out[node] = (n, round(w, 9), round(p, 9), -1 if f is None else f)
        return f is None, 2 * p > w

    grow(np.flatnonzero(times), 0, 0)
    return out


@pytest.mark.parametrize("deepest", [3, 30])
def test_a_tree_of_the_forest_equals_one_grown_row_by_row(deepest, monkeypatch):
    monkeypatch.setattr(R, "COUNTED_NODES", 3)
    rng = np.random.default_rng(4)
    codes = np.column_stack([rng.integers(0, 8, 250), rng.integers(0, 6, 250), rng.random(250) < 0.3]).astype(np.uint8)
    label = ((codes[:, 0] > 3) ^ (rng.random(250) < 0.2)).astype(float)
    weight = np.where(label > 0, 1.25, 0.75) * rng.choice([1.0, 1.01], 250)
    splits = [np.arange(7.0), np.arange(5.0) * 10, np.array([0.5])]
    times = np.random.default_rng([42, 7]).poisson(1.0, 250)  # the tree's own draw
    want = naive_tree(codes, label, weight * times, times, splits, deepest)
    got = {}
    for batch in R._tree(codes, label, weight, splits, 7, 42, 3, deepest, 1):
        for r in batch.to_pylist():
            got[r["node"]] = (r["n"], round(r["weight"], 9), round(r["positive"], 9), -1 if r["feature"] is None else r["feature"])
            assert r["tree"] == 7 and (r["node"] + 1).bit_length() - 1 == r["depth"] <= deepest
            assert (r["threshold"] is None) == (r["feature"] is None) and (r["feature"] is None or r["threshold"] in splits[r["feature"]])
    assert len(want) > (5 if deepest == 3 else 20) and got == want


def test_bins_are_those_of_spark():
    few = np.array([1.0, 2, 4])
    assert R._stride_splits(few, np.ones(3), 5).tolist() == [1.5, 3.0]
    assert R._stride_splits(np.arange(100.0), np.ones(100), 3).tolist() == [24.5, 49.5, 74.5]
    heavy = R._stride_splits(np.arange(100.0), np.where(np.arange(100) < 10, 9.0, 1.0), 3)
    assert heavy.tolist() == [4.5, 9.5, 54.5]


def test_a_large_forest_is_a_table_and_as_good_as_sparks(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    x, z, c = rng.normal(size=3000), rng.exponential(size=3000), rng.choice(["a", "b", "c"], 3000)
    y = (x + (c == "a") + 0.5 * rng.normal(size=3000) > 0.8).astype(int)
    split = spark.createDataFrame(pd.DataFrame({"id": range(3000), "x": x, "z": z, "c": c, "y": y, "split": np.where(np.arange(3000) % 5 < 3, "train", np.where(np.arange(3000) % 5 == 3, "val", "test"))}))
    train = lambda: N.train(split, ["x", "z"], ["c"], "y", ["id"], {"random_forest": N.candidates(num_trees=20, max_depth=12)["random_forest"]})
    theirs = train()
    assert isinstance(theirs.model, RandomForestClassificationModel)
    monkeypatch.setattr(R, "SPARK_ROWS", 500)
    ours = train()
    assert isinstance(ours.model, ExtraTreesModel) and ours.model.nodes.select("tree").distinct().count() == 20
    a, b = (r.metrics.first() for r in (ours, theirs))
    assert abs(a["test_roc_auc"] - b["test_roc_auc"]) < 0.02 and abs(a["train_roc_auc"] - b["train_roc_auc"]) < 0.02
    assert 0.8 < ours.model.nodes.count() / theirs.model.totalNumNodes < 1.25
    roots = ours.model.nodes.where("node = 0")
    assert 0.9 < roots.agg(F.avg("n")).first()[0] / 1800 < 1.1 and roots.select("n").distinct().count() > 5  # a bootstrap each
    ours.model.save(str(tmp_path / "forest"))
    again = N.score(ExtraTreesModel.load(str(tmp_path / "forest")), ours.encoder, ours.preprocessor, split)
    assert M.max_abs_diff(ours.score(split), again, ["id"]).first()["within"]
    (table,) = N.as_tables(ours.model, ours.encoder, ours.preprocessor).values()
    assert {"tree", "node", "depth", "n", "weight", "positive", "feature", "threshold", "value"} == set(table.columns)
