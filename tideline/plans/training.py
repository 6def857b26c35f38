"""Preprocessing, candidate training, replay and retrain jobs on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import evaluate as M
from tideline.operators.hashrank import order_key
from tideline.operators.profile import ReferenceProfile, category_counts, long_numeric, reference_profile
from tideline.operators.quantiles import exact_quantiles, finite_or_null
from tideline.operators.registry import register_staging, retrain_decision
from tideline.operators.sampling import SEED
from tideline.plans.extra_trees import ExtraTrees
from tideline.plans.model_tables import as_tables
from tideline.plans.random_forest import RandomForest
from tideline.session import cut
from tideline.sources.tables import append_run_metrics, dataset_fingerprint
from tideline.sources.versioned import Version, publish

MIN_RECALL = M.MIN_RECALL


def imputation_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``feature, number, text``: exact median of numeric columns, most frequent category (smallest on ties)."""
    medians = exact_quantiles(long_numeric(df, numeric), [0.5]).select(
        "feature", F.get("quantiles", F.lit(0)).alias("number"), F.lit(None).cast("string").alias("text")
    )
    counts = category_counts(df, categorical).where(F.col("category").isNotNull())
    modes = counts.groupBy("feature").agg(F.min(F.struct((-F.col("count")).alias("c"), "category")).alias("m"))
    return medians.unionByName(modes.select("feature", F.lit(None).cast("double").alias("number"), F.col("m.category").alias("text")))


@dataclass(frozen=True)
class Preprocessor:
    """Column statistics of the training rows; one number or text per column."""

    medians: Mapping[str, float]
    means: Mapping[str, float]
    stds: Mapping[str, float]
    modes: Mapping[str, str]

    def impute(self, df: DataFrame) -> DataFrame:
        columns = {c: F.coalesce(finite_or_null(F.col(c)), F.lit(v)) for c, v in self.medians.items()}
        columns |= {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in self.modes.items()}
        return df.withColumns(columns)

    def standardize(self, df: DataFrame) -> DataFrame:
        """Imputed, numeric columns scaled by mean and population standard deviation."""
        scaled = {c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.stds[c] or 1.0) for c in self.medians}
        return self.impute(df).withColumns(scaled)


def fit_preprocessor(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Preprocessor:
    rows = imputation_values(df, numeric, categorical).collect()  # one row per column
    medians = {r["feature"]: r["number"] for r in rows if r["number"] is not None}
    modes = {r["feature"]: r["text"] for r in rows if r["text"] is not None}
    filled = {c: F.coalesce(finite_or_null(F.col(c)), F.lit(v)) for c, v in medians.items()}
    if not filled:
        return Preprocessor({}, {}, {}, modes)
    row = df.agg(*[F.avg(v).alias(f"m_{c}") for c, v in filled.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items()]).first()
    return Preprocessor(medians, {c: row[f"m_{c}"] for c in filled}, {c: row[f"s_{c}"] for c in filled}, modes)


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """Indexed and one-hot encoded categories (an unknown one gives zeros) next to the numbers."""
    indexed = [f"{c}__i" for c in categorical]
    encoded = [f"{c}__v" for c in categorical]
    stages = []
    if categorical:
        stages = [
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numeric, *encoded], outputCol="features")])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (2 * n_class)`` as ``class, weight``."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total), F.lit(True)).select("class", (F.col("n") / (2 * F.col("n_class"))).alias("weight"))  # one total row


def dummy_baseline(df: DataFrame, label: str, train: DataFrame, ids: Sequence[str], seed: int = SEED, out: str = "probability") -> DataFrame:
    """Class drawn with the training prior, decided by the row's own hash."""
    prior = train.agg(F.avg((F.col(label) == 1).cast("double"))).first()[0] or 0.0
    return df.withColumn(out, (order_key(ids, f"dummy{seed}") < F.lit(prior * 16.0**13)).cast("double"))


#: Rows of a part of the training rows, at least where there are more parts than one, and at most where there are more parts than cores.
FIT_ROWS = (10_000, 1_000_000)
#: The deepest trees that Spark grows; in effect no limit.
MAX_DEPTH = 30
Builder = Callable[[float], object] | None  # None: the hash-drawn baseline


def candidates(num_trees: int = 100, max_depth: int = MAX_DEPTH, max_iter: int = 1000, seed: int = SEED) -> dict[str, Builder]:
    """Estimators by name, each from the total row weight. The order breaks ties of the selection."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "dummy": None,
        "logistic_regression": lambda total: LogisticRegression(
            regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=max_iter, **common
        ),
        "random_forest": lambda total: RandomForest(
            numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True, **common
        ),
        "extra_trees": lambda total: ExtraTrees(num_trees, max_depth, seed=seed),
    }


@dataclass
class TrainResult:
    """Selected model (with its preprocessing), its threshold, and the metrics of all candidates."""

    name: str
    preprocessor: Preprocessor
    encoder: PipelineModel
    model: Model | None
    threshold: float
    metrics: DataFrame

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` of class 1."""
        if self.model is None:
            raise ValueError("the baseline has no model to score with")
        return score(self.model, self.encoder, self.preprocessor, df)


def score(model: Model, encoder: PipelineModel, preprocessor: Preprocessor, df: DataFrame) -> DataFrame:
    columns = df.columns
    scored = model.transform(encoder.transform(_shadow(preprocessor, df)))
    return scored.select(*[f"`{c}`" for c in columns], vector_to_array("probability")[1].alias("score")).withColumnRenamed("score", "probability")


def _shadow(preprocessor: Preprocessor, df: DataFrame) -> DataFrame:
    """Standardised copies of the feature columns beside the originals, as the encoder expects them."""
    names = [*preprocessor.medians, *preprocessor.modes]
    copied = df.withColumns({f"x_{c}": F.col(c) for c in names})
    prefixed = Preprocessor(
        *[{f"x_{c}": v for c, v in part.items()} for part in (preprocessor.medians, preprocessor.means, preprocessor.stds, preprocessor.modes)]
    )
    return prefixed.standardize(copied)


def fit_parts(rows: int, cores: int) -> int:
    """Parts to fit a model on. Every part of a forest's rows sends statistics of all open nodes, so their number is kept to the cores."""
    least, most = FIT_ROWS
    return max(1, -(-rows // most), min(cores, rows // least))


def train(
    split: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    ids: Sequence[str],
    builders: Mapping[str, Builder] | None = None,
    min_recall: float = MIN_RECALL,
    run_id: str = "run",
) -> TrainResult:
    """Fit all candidates, pick thresholds on the validation part, select by validation F1.

    ``split`` carries a ``split`` column (train, val, test). The loop runs over candidates; each
    candidate's metrics are a handful of numbers.
    """
    builders = builders if builders is not None else candidates()
    spark = split.sparkSession
    rows = split.where(F.col(label).isNotNull())
    fit_rows = rows.where(F.col("split") == "train")
    pre = fit_preprocessor(fit_rows, numeric, categorical)
    encoder = feature_pipeline([f"x_{c}" for c in pre.medians], [f"x_{c}" for c in pre.modes]).fit(_shadow(pre, fit_rows))
    weights = class_weights(fit_rows, label).collect()  # one row per class
    weight = F.lit(1.0)
    for r in weights:
        weight = F.when(F.col(label) == r["class"], F.lit(r["weight"])).otherwise(weight)
    frame = encoder.transform(_shadow(pre, rows)).select(
        *ids, "split", F.col(label).cast("double").alias("label"), weight.alias("weight"), "features"
    ).persist()
    try:
        sums = frame.where(F.col("split") == "train").agg(F.sum("weight"), F.count(F.lit(1))).first()
        total, parts = float(sums[0]), fit_parts(sums[1], spark.sparkContext.defaultParallelism)
        fitted: dict[str, Model | None] = {}
        table = []
        for ordinal, name in enumerate(builders):
            if builders[name] is None:
                fitted[name] = None
                scored = dummy_baseline(frame.drop("features"), "label", frame.where(F.col("split") == "train"), ids)
            else:
                fitted[name] = builders[name](total).fit(frame.where(F.col("split") == "train").coalesce(parts))
                scored = fitted[name].transform(frame.select(*ids, "split", "label", "features")).select(
                    *ids, "split", "label", vector_to_array("probability")[1].alias("score")
                ).withColumnRenamed("score", "probability")
            scored = cut(scored.select("split", "label", "probability"))  # every candidate scores its rows once
            part = lambda p: scored.where(F.col("split") == p)  # noqa: B023, E731
            limit = M.operating_threshold(part("val"), "probability", "label", min_recall).first()["operating_threshold"]
            numbers = {"run_id": run_id, "ordinal": ordinal, "candidate": name, "threshold": float(limit)}
            found = {r["split"]: r.asDict() for r in M.replay_metrics(scored, "probability", "label", limit, ["split"]).collect()}
            for p in ("train", "val", "test"):
                for metric in ("accuracy", "precision", "recall", "f1", "roc_auc"):
                    numbers[f"{p}_{metric}"] = found.get(p, {}).get(metric)
            gap = (numbers["train_roc_auc"], numbers["val_roc_auc"])
            numbers["train_val_auc_gap"] = None if None in gap else gap[0] - gap[1]
            table.append(numbers)
    finally:
        frame.unpersist()
    schema = "run_id string, ordinal int, candidate string, threshold double, " + ", ".join(
        f"{p}_{m} double" for p in ("train", "val", "test") for m in ("accuracy", "precision", "recall", "f1", "roc_auc")
    ) + ", train_val_auc_gap double"
    metrics = spark.createDataFrame(table, schema)
    best = M.select_best_candidate(metrics).first()
    return TrainResult(best["candidate"], pre, encoder, fitted[best["candidate"]], best["threshold"], metrics)


def run_report(result: TrainResult, split: DataFrame, label: str) -> DataFrame:
    """The metrics of all candidates with what the run was made of: hash of the rows, rows of each part, which one was taken."""
    labelled = split.where(F.col(label).isNotNull())
    parts = labelled.agg(*[F.count(F.when(F.col("split") == p, 1)).alias(f"{p}_rows") for p in ("train", "val", "test")])
    facts = dataset_fingerprint(labelled).select(F.col("fingerprint").alias("dataset_hash")).join(F.broadcast(parts), F.lit(True))  # one row each
    return result.metrics.join(F.broadcast(facts), F.lit(True)).withColumn("selected", F.col("candidate") == result.name)


def replay(
    model: Model, encoder: PipelineModel, preprocessor: Preprocessor, rows: DataFrame, label: str, threshold: float,
    sink: str | None = None,
) -> DataFrame:
    """Metrics of a serving model on held-out rows; appended to ``sink`` if given."""
    metrics = M.replay_metrics(score(model, encoder, preprocessor, rows), "probability", label, threshold)
    if sink:
        append_run_metrics(metrics, sink)
    return metrics


@dataclass
class Retrained:
    """What a retrain run has made; ``published`` is the version of the registry folder it is in."""

    result: TrainResult
    profile: ReferenceProfile | None
    decision: DataFrame
    report: DataFrame
    versions: DataFrame
    published: Version | None = None


def retrain(
    split: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    ids: Sequence[str],
    versions: DataFrame,
    model_name: str,
    builders: Mapping[str, Builder] | None = None,
    run_id: str = "run",
    reference_threshold: float = 0.5,
    registry: str | None = None,
) -> Retrained:
    """Train, profile the test part under the new model, register it in Staging, decide on promotion.

    The new version follows the model's greatest one and archives older Staging versions. With ``registry`` the
    profile, the versions, the run's report, the model itself and its table of terms or nodes are published there as one version: they
    appear together or not at all. Before that the model is read back from storage and has to give
    the same scores (:func:`evaluate.max_abs_diff`). The baseline has no profile and is not registered; then
    only the report is new.
    """
    result = train(split, numeric, categorical, label, ids, builders, run_id=run_id)
    report = cut(run_report(result, split, label))
    chosen = report.where("selected")
    new = chosen.select(F.lit(model_name).alias("model"), F.col("test_roc_auc").alias("new_auc"), "run_id")
    if result.model is None:
        done = Retrained(result, None, retrain_decision(new, versions), report, versions)
        if registry is not None:
            done.published = publish(split.sparkSession, registry, {"versions": versions, "report": report}, {"model": model_name, "run_id": run_id, "candidate": result.name})
        return done
    tested = split.where(F.col("split") == "test")
    profile = reference_profile(result.score(tested), numeric, categorical, (F.col("probability") >= reference_threshold).cast("int"))
    greatest = versions.where(F.col("model") == model_name).agg(F.coalesce(F.max(F.col("version").cast("int")), F.lit(0)).alias("greatest"))
    tags = {"auc": "test_roc_auc", "recall": "test_recall", "operating_threshold": "threshold", "dataset_hash": "dataset_hash", "candidate": "candidate"}
    row = chosen.join(F.broadcast(greatest), F.lit(True)).select(
        F.lit(model_name).alias("model"), (F.col("greatest") + 1).cast(versions.schema["version"].dataType).alias("version"), "run_id",
        F.map_from_arrays(F.array(*map(F.lit, tags)), F.array(*[F.col(c).cast("string") for c in tags.values()])).alias("tags"),
    )
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in versions.schema if f.name not in (*row.columns, "stage")]
    registered = cut(register_staging(versions, row.select("*", *missing)))
    done = Retrained(result, profile, retrain_decision(new, versions), report, registered)
    if registry is not None:

        def saved(folder: str) -> dict:
            result.model.save(f"{folder}/model")
            result.encoder.save(f"{folder}/encoder")
            again = score(type(result.model).load(f"{folder}/model"), PipelineModel.load(f"{folder}/encoder"), result.preprocessor, tested)
            gap = M.max_abs_diff(result.score(tested), again, ids).first()
            if not gap["within"]:
                raise ValueError(f"the stored model differs from the trained one by {gap['max_abs_diff']}")
            return {"max_abs_diff": gap["max_abs_diff"]}

        pre = result.preprocessor
        columns = [(c, pre.medians[c], pre.means[c], pre.stds[c], None) for c in pre.medians] + [(c, None, None, None, m) for c, m in pre.modes.items()]
        steps = split.sparkSession.createDataFrame(columns, "feature string, median double, mean double, std double, mode string")
        parts = {"preprocessing": steps} | {f"profile_{p}": getattr(profile, p) for p in ("numeric", "categorical", "output")} | {"versions": registered, "report": report}
        parts |= as_tables(result.model, result.encoder, pre)
        done.published = publish(split.sparkSession, registry, parts, {"model": model_name, "run_id": run_id, "candidate": result.name}, saved)
    return done
