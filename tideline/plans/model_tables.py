"""Fitted models as tables, and scores by DataFrame expressions over those tables.

A logistic regression is a table of terms: one row for the intercept, for each number and for each category, with what
fills and scales the column. A forest is a table of nodes in the layout of :class:`ExtraTreesModel`. Both can be read,
joined and compared like any other table, and scored where no ML model can be loaded.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.quantiles import finite_or_null
from tideline.plans.extra_trees import ExtraTreesModel
from tideline.session import scratch_path, stored

if TYPE_CHECKING:
    from tideline.plans.training import Preprocessor

TERMS = "kind string, feature string, category string, fill_number double, fill_text string, mean double, std double, coefficient double"


def logistic_terms(model: LogisticRegressionModel, encoder: PipelineModel, pre: Preprocessor) -> DataFrame:
    """``kind`` is intercept, number or category; a text column without any category still has a row, with its fill only."""
    weights = model.coefficients.toArray().tolist()
    rows: list[tuple] = [("intercept", None, None, None, None, None, None, float(model.intercept))]
    rows += [("number", c, None, pre.medians[c], None, pre.means[c], pre.stds[c] or 1.0, w) for c, w in zip(pre.medians, weights)]
    at = len(pre.medians)
    for feature, labels in zip(pre.modes, encoder.stages[0].labelsArray if pre.modes else []):
        rows.append(("text", feature, None, None, pre.modes[feature], None, None, 0.0))
        rows += [("category", feature, c, None, None, None, None, w) for c, w in zip(labels, weights[at : at + len(labels)], strict=True)]
        at += len(labels)
    if at != len(weights):
        raise ValueError(f"the encoder makes {at} columns, the model has {len(weights)}")
    return SparkSession.active().createDataFrame(rows, TERMS)


def logistic_features(df: DataFrame, terms: DataFrame) -> tuple[DataFrame, list[dict], list[str]]:
    """``df`` with filled columns ``x_<feature>``, the rows of its plain terms, and the text columns."""
    plain = [r.asDict() for r in terms.where("kind <> 'category'").collect()]  # one row per column
    numbers, texts = ([r for r in plain if r["kind"] == k] for k in ("number", "text"))
    filled = {f"x_{r['feature']}": (F.coalesce(finite_or_null(F.col(f"`{r['feature']}`")), F.lit(r["fill_number"])) - F.lit(r["mean"])) / F.lit(r["std"]) for r in numbers}
    filled |= {f"x_{r['feature']}": F.coalesce(F.col(f"`{r['feature']}`").cast("string"), F.lit(r["fill_text"])) for r in texts}
    return df.withColumns(filled), plain, [r["feature"] for r in texts]


def score_logistic(df: DataFrame, terms: DataFrame, out: str = "probability") -> DataFrame:
    """Add ``out``. Numbers are an expression; categories, of which there may be many, are joined, and an unknown one adds nothing."""
    filled, plain, texts = logistic_features(df, terms)
    margin = F.lit(sum(r["coefficient"] for r in plain if r["kind"] == "intercept"))
    for r in plain:
        if r["kind"] == "number":
            margin = margin + F.col(f"x_{r['feature']}") * F.lit(r["coefficient"])
    for feature in texts:
        known = terms.where((F.col("kind") == "category") & (F.col("feature") == feature)).select(F.col("category").alias(f"x_{feature}"), F.col("coefficient").alias(f"w_{feature}"))
        filled = filled.join(known, f"x_{feature}", "left")
        margin = margin + F.coalesce(F.col(f"w_{feature}"), F.lit(0.0))
    return filled.select(*[F.col(f"`{c}`") for c in df.columns], (1 / (1 + F.exp(-margin))).alias(out))


def forest_nodes(model: RandomForestClassificationModel) -> DataFrame:
    """``tree, node, depth, n, weight, positive, feature, threshold, value`` of a random forest.

    Node k's children are 2k + 1 (at or below the threshold) and 2k + 2. Nodes are read from the stored model and numbered
    a level at a time. A split of a 0/1 column by its values becomes one at 0.5; other splits by category are refused.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.save(path)
    raw = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    if not raw.where("split.numCategories > 2").isEmpty():
        raise ValueError("a split by more than two categories has no threshold")
    by_value = F.col("split.numCategories") == 2
    swapped = by_value & F.array_contains("split.leftCategoriesOrThreshold", F.lit(1.0))
    inner, stats = F.col("leftChild") >= 0, F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    positive = F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0))
    table = stored(raw.select(
        "tree", "id", F.col("rawCount").alias("n"), total.alias("weight"), positive.alias("positive"), (positive / total).alias("value"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.when(by_value, 0.5).otherwise(F.get("split.leftCategoriesOrThreshold", F.lit(0)))).alias("threshold"),
        F.when(inner, F.when(swapped, F.array("rightChild", "leftChild")).otherwise(F.array("leftChild", "rightChild"))).alias("children"),
    ), "nodes")
    level, levels = table.where("id = 0").withColumn("node", F.lit(0).cast("bigint")), []
    for depth in range(model.getOrDefault("maxDepth") + 1):
        level = stored(level.withColumn("depth", F.lit(depth)), "level")
        levels.append(level)
        below = level.where("children is not null").select("tree", "node", F.posexplode("children").alias("side", "id"))
        if below.isEmpty():
            break
        level = below.select("tree", "id", (2 * F.col("node") + 1 + F.col("side")).alias("node")).join(table, ["tree", "id"]).select(*table.columns, "node")
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found.select("tree", "node", "depth", "n", "weight", "positive", "feature", "threshold", "value")


def as_tables(model, encoder: PipelineModel, pre: Preprocessor) -> dict[str, DataFrame]:
    """``model_terms`` or ``model_nodes`` of a model that :func:`train` may select."""
    if isinstance(model, LogisticRegressionModel):
        return {"model_terms": logistic_terms(model, encoder, pre)}
    return {"model_nodes": model.nodes if isinstance(model, ExtraTreesModel) else forest_nodes(model)}
