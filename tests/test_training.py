import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tideline.operators import evaluate as M
from tideline.operators.sampling import stratified_split
from tideline.plans import extra_trees as X
from tideline.plans import model_tables as T
from tideline.plans import training as N
from tideline.plans.extra_trees import ExtraTrees, ExtraTreesModel
from tideline.sources import versioned as V

RNG = np.random.default_rng(1)
ROWS = 400


@pytest.fixture(scope="module")
def split(spark):
    x = RNG.normal(size=ROWS)
    c = RNG.choice(["a", "b", "c"], ROWS)
    y = (x + (c == "a") + RNG.normal(size=ROWS) > 0.8).astype(int)
    x[:20] = np.nan
    df = pd.DataFrame({"id": np.arange(ROWS), "x": x, "z": RNG.exponential(size=ROWS), "c": np.where(np.arange(ROWS) % 37 == 0, None, c), "y": y})
    return stratified_split(spark.createDataFrame(df), "y", ["id"]).persist()


@pytest.fixture(scope="module")
def result(split):
    builders = N.candidates(num_trees=5, max_depth=4, max_iter=100)
    return N.train(split, ["x", "z"], ["c"], "y", ["id"], builders)


def test_preprocessing_statistics(split):
    pdf = split.toPandas()
    pre = N.fit_preprocessor(split, ["x", "z"], ["c"])
    assert pre.medians["x"] == pytest.approx(np.nanmedian(pdf["x"]))
    assert pre.modes["c"] == pdf["c"].mode().min()
    filled = pdf["x"].fillna(np.nanmedian(pdf["x"]))
    got = pre.standardize(split).orderBy("id").toPandas()["x"]
    want = ((filled - filled.mean()) / filled.std(ddof=0))[pdf.sort_values("id").index]
    np.testing.assert_allclose(got, want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_all_candidates_are_measured_and_the_best_is_taken(result):
    rows = {r["candidate"]: r for r in result.metrics.collect()}
    assert list(rows) == ["dummy", "logistic_regression", "random_forest", "extra_trees"]
    assert rows["logistic_regression"]["test_roc_auc"] > 0.7
    assert abs(rows["dummy"]["val_roc_auc"] - 0.5) < 0.2
    assert result.name == max(rows.values(), key=lambda r: (r["val_f1"], -r["ordinal"]))["candidate"]
    assert all(r["val_recall"] >= 0.75 for r in rows.values())
    lr = rows["logistic_regression"]
    assert lr["train_val_auc_gap"] == pytest.approx(lr["train_roc_auc"] - lr["val_roc_auc"])


def test_scores_survive_saving(result, split, tmp_path):
    lr = N.train(split, ["x", "z"], ["c"], "y", ["id"], {"logistic_regression": N.candidates()["logistic_regression"]})
    lr.model.save(str(tmp_path / "lr"))
    again = N.score(LogisticRegressionModel.load(str(tmp_path / "lr")), lr.encoder, lr.preprocessor, split)
    assert M.max_abs_diff(lr.score(split), again, ["id"]).first()["within"]
    # an unknown category scores with all indicators at zero
    other = split.withColumn("c", F.lit("never seen"))
    assert lr.score(other).where("probability is null").isEmpty()


def test_logistic_scores_from_terms(spark, split, tmp_path):
    lr = N.train(split, ["x", "z"], ["c"], "y", ["id"], {"logistic_regression": N.candidates()["logistic_regression"]})
    path = str(tmp_path / "terms")
    T.logistic_terms(lr.model, lr.encoder, lr.preprocessor).write.parquet(path)
    terms = spark.read.parquet(path)
    assert {(r["feature"], r["category"]) for r in terms.where("kind = 'category'").collect()} == {("c", v) for v in "abc"}
    odd = split.limit(3).withColumns({"id": F.col("id") + 10_000, "c": F.lit("never seen"), "x": F.lit(None).cast("double")})
    rows = split.unionByName(odd)
    assert T.score_logistic(rows, terms).columns == [*rows.columns, "probability"]
    diff = M.max_abs_diff(lr.score(rows), T.score_logistic(rows, terms), ["id"]).first()
    assert diff["within"] and diff["n_rows"] == ROWS + 3
    assert T.score_logistic(rows.where("false"), terms).count() == 0


def test_forest_scores_from_nodes(split):
    rf = N.train(split, ["x", "z"], ["c"], "y", ["id"], {"random_forest": N.candidates(num_trees=6, max_depth=7)["random_forest"]})
    nodes = T.forest_nodes(rf.model)
    assert nodes.groupBy("tree").count().count() == 6 and nodes.select("tree", "node").distinct().count() == nodes.count() == rf.model.totalNumNodes
    # what goes in at a node comes out of its children
    kids = nodes.select("tree", F.floor((F.col("node") - 1) / 2).alias("node"), F.col("n").alias("below")).where("node >= 0").groupBy("tree", "node").agg(F.sum("below").alias("below"))
    assert nodes.where("feature is not null").join(kids, ["tree", "node"], "full_outer").where("not (n <=> below)").isEmpty()
    again = N.score(ExtraTreesModel(nodes, 6), rf.encoder, rf.preprocessor, split)
    assert M.max_abs_diff(rf.score(split), again, ["id"]).first()["within"]


def test_replay_appends_its_metrics(spark, split, tmp_path):
    lr = N.train(split, ["x", "z"], ["c"], "y", ["id"], {"logistic_regression": N.candidates()["logistic_regression"]})
    sink = str(tmp_path / "runs")
    row = N.replay(lr.model, lr.encoder, lr.preprocessor, split.where("split = 'test'"), "y", lr.threshold, sink).first()
    assert spark.read.parquet(sink).first()["roc_auc"] == row["roc_auc"] == pytest.approx(lr.metrics.first()["test_roc_auc"])


GROWN, TREES = 100, 3
HAVE = "model string, version int, stage string, run_id string, tags map<string,string>"


@pytest.mark.parametrize("auc,decision", [("0.1", "request_promotion"), ("0.999", "keep"), (None, "request_promotion")])
def test_retrain_decides_against_production(spark, split, auc, decision):
    have = spark.createDataFrame([("m", 1, "Production" if auc else "Archived", "r", {"auc": auc or "1"})], HAVE)
    builders = {"logistic_regression": N.candidates(max_iter=20)["logistic_regression"]}
    done = N.retrain(split, ["x", "z"], ["c"], "y", ["id"], have, "m", builders)
    assert done.decision.first()["decision"] == decision
    assert {r["feature"] for r in done.profile.numeric.collect()} == {"x", "z"}


@pytest.mark.parametrize("candidate", ["logistic_regression", "extra_trees"])
def test_retrain_publishes_everything_at_once(spark, split, tmp_path, monkeypatch, candidate):
    path = str(tmp_path / "registry")
    have = spark.createDataFrame([("m", 3, "Staging", "old", {"auc": "0.1"}), ("m", 2, "Production", "older", {"auc": "0.1"}), ("other", 9, "Staging", "o", {})], HAVE)
    builders = {candidate: N.candidates(num_trees=4, max_depth=4, max_iter=20)[candidate]}
    retrain = lambda: N.retrain(split, ["x", "z"], ["c"], "y", ["id"], have, "m", builders, run_id="r9", registry=path)
    done = retrain()
    found = V.read_version(spark, path)
    assert found.number == done.published.number == 0 and found.info["max_abs_diff"] <= 1e-12 and found.info["candidate"] == candidate
    rows = {(r["model"], r["version"]): r for r in found.table("versions").collect()}
    assert {k: r["stage"] for k, r in rows.items()} == {("m", 4): "Staging", ("m", 3): "Archived", ("m", 2): "Production", ("other", 9): "Staging"}
    assert found.table("model_terms" if candidate == "logistic_regression" else "model_nodes").count() > 4
    report = found.table("report").first()
    assert rows["m", 4]["tags"]["dataset_hash"] == report["dataset_hash"] and float(rows["m", 4]["tags"]["auc"]) == pytest.approx(report["test_roc_auc"])
    assert report["selected"] and report["train_rows"] + report["val_rows"] + report["test_rows"] == ROWS
    assert {r["feature"] for r in found.table("profile_numeric").collect()} == {"x", "z"} and found.table("preprocessing").count() == 3
    monkeypatch.setattr(M, "max_abs_diff", lambda *a: spark.createDataFrame([(False, 0.5)], "within boolean, max_abs_diff double"))
    with pytest.raises(ValueError, match="differs"):
        retrain()
    assert V.read_version(spark, path).number == 0  # a model that does not come back as it was leaves no version


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=GROWN), rng.integers(0, 3, GROWN), np.full(GROWN, 7.0), rng.exponential(size=GROWN)])
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    frame = spark.createDataFrame(pd.DataFrame({"id": range(GROWN), "x": x.tolist(), "label": y, "weight": np.where(y > 0, 2.0, 1.0)}))
    frame = frame.withColumn("features", array_to_vector("x"))
    return x, y, frame, ExtraTrees(num_trees=TREES, max_depth=30, seed=5).fit(frame)


def test_extra_trees_nodes_hold_what_they_say(grown):
    """Every row is sent down every tree by hand: counts, weights, ranges and leaves have to agree with the table."""
    x, y, frame, model = grown
    nodes = {(r["tree"], r["node"]): r for r in model.nodes.collect()}
    assert len(nodes) == model.nodes.count() and {t for t, _ in nodes} == set(range(TREES))
    members, leaves = {}, np.zeros((GROWN, TREES))
    for row in range(GROWN):
        for tree in range(TREES):
            node = 0
            while True:
                members.setdefault((tree, node), []).append(row)
                r = nodes[tree, node]
                if r["feature"] is None:
                    leaves[row, tree] = r["value"]
                    break
                node = 2 * node + (1 if x[row, r["feature"]] <= r["threshold"] else 2)
    assert members.keys() == nodes.keys()
    for key, rows in members.items():
        r, w = nodes[key], np.where(y[rows] > 0, 2.0, 1.0)
        assert r["n"] == len(rows) and r["weight"] == w.sum() and r["positive"] == (w * y[rows]).sum()
        assert r["low"] == x[rows].min(axis=0).tolist() and r["high"] == x[rows].max(axis=0).tolist()
        pure = len(set(y[rows])) == 1
        assert (r["feature"] is None) == (pure or (x[rows] == x[rows][0]).all())
        if r["feature"] is not None:
            assert r["low"][r["feature"]] <= r["threshold"] < r["high"][r["feature"]] and r["feature"] != 2
    scored = {r["id"]: r["p"] for r in model.transform(frame).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert all(abs(scored[i] - leaves[i].mean()) < 1e-12 for i in range(GROWN))


def test_extra_trees_are_repeatable_random_and_limited(grown, spark):
    x, y, frame, model = grown
    key = lambda m: sorted((r["tree"], r["node"], r["feature"], r["threshold"]) for r in m.nodes.where("feature is not null").collect())
    short = lambda seed, df: key(ExtraTrees(num_trees=TREES, max_depth=1, seed=seed).fit(df))
    assert short(5, frame.repartition(3)) == [k for k in key(model) if k[1] == 0] != short(6, frame)
    roots = {(r["feature"], r["threshold"]) for r in model.nodes.where("node = 0").collect()}
    assert len(roots) == TREES
    small = ExtraTrees(num_trees=2, max_depth=2, min_rows=30).fit(frame).nodes
    assert small.agg({"depth": "max"}).first()[0] <= 2 and small.where("n < 30 and feature is not null").isEmpty()
    one = ExtraTrees(num_trees=2).fit(frame.where("label = 1"))
    assert one.nodes.count() == 2 and one.transform(frame).where(vector_to_array("probability")[1] != 1).isEmpty()


def test_nodes_below_the_bound_equal_those_grown_by_levels(grown, monkeypatch):
    """Rows meet below a node of few rows; the nodes and scores are those of whole levels, and the rows are stored once, not for every level."""
    x, y, frame, model = grown
    key = lambda m: sorted((r["tree"], r["node"], r["depth"], r["n"], r["weight"], r["positive"], tuple(r["low"]), tuple(r["high"]), r["feature"], r["threshold"]) for r in m.nodes.collect())
    score = lambda m: {r["id"]: r["p"] for r in m.transform(frame).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    whole, wanted = key(model), score(model)
    tables, write = [], X.stored
    monkeypatch.setattr(X, "stored", lambda df, *a: tables.append(df) or write(df, *a))
    ExtraTrees(num_trees=TREES, max_depth=30, seed=5).fit(frame)
    assert len(tables) <= 4 < max(k[2] for k in whole)
    monkeypatch.setattr(X, "stored", write)
    monkeypatch.setattr(X, "SUBTREE_ROWS", 9)
    mixed = ExtraTrees(num_trees=TREES, max_depth=30, seed=5).fit(frame)
    assert key(mixed) == whole
    got = score(mixed)
    assert got.keys() == wanted.keys() and all(abs(got[i] - p) < 1e-12 for i, p in wanted.items())


def test_a_forest_keeps_node_ids_and_few_parts(split):
    """Rows in many parts come to the models in few; the forest is the one without kept node ids."""
    seen = []

    class Watched:
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return N.candidates(num_trees=2, max_depth=5)["random_forest"](1.0).fit(df)

    found = N.train(split.repartition(30), ["x", "z"], ["c"], "y", ["id"], {"forest": lambda total: Watched()})
    assert seen == [1] and [N.fit_parts(n, 12) for n in (0, 9_999, 50_000, 10**6, 10**8)] == [1, 1, 5, 12, 100]
    forest = N.candidates(num_trees=3, max_depth=8)["random_forest"](1.0)
    rows = found.encoder.transform(N._shadow(found.preprocessor, split)).select(F.col("y").cast("double").alias("label"), F.lit(1.0).alias("weight"), "features").coalesce(1)
    plain = forest.copy({forest.cacheNodeIds: False}).fit(rows)
    body = lambda m: m.toDebugString.split("\n", 1)[1]
    assert forest.getCacheNodeIds() and body(forest.fit(rows)) == body(plain)
