"""Evaluation of scored rows: confusion metrics, exact ROC AUC, PR curve, operating thresholds.

All curve work starts from one aggregate: positives and negatives per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordered import running_totals
from tideline.session import cut

MIN_RECALL = 0.75


def score_counts(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, score, pos, neg`` for every distinct score."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def cumulative_counts(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Score counts with running totals from the highest score down.

    The counts are fixed in shared storage: the totals need them three times (balance, offsets, rows).
    """
    counts = cut(score_counts(df, score, label, keys))
    return running_totals(counts, "score", ["pos", "neg"], keys, True, buckets)


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. NULL with a single class."""
    curve = cumulative_counts(df, score, label, keys, buckets)
    # negatives at this score lose to every positive above and tie with those at the score
    wins = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2.0))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return curve.groupBy(*keys).agg((wins / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold."""
    curve = cumulative_counts(df, score, label, keys, buckets)
    hits = F.col("cum_pos").cast("double")
    precision = hits / (F.col("cum_pos") + F.col("cum_neg"))
    recall = F.when(F.col("all_pos") > 0, hits / F.col("all_pos")).otherwise(1.0)
    both = precision + recall
    f1 = 2 * precision * recall / F.when(both > 0, both).otherwise(1.0)
    return curve.select(
        *keys, F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def operating_threshold(
    df: DataFrame, score: str, label: str, min_recall: float = MIN_RECALL, keys: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Highest threshold with recall >= ``min_recall``; else the lowest one with the best F1.

    Also gives ``f1_optimal`` itself.
    """
    curve = pr_curve(df, score, label, keys, buckets)
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("low")))
    picked = curve.groupBy(*keys).agg(
        F.max(F.when(F.col("recall") >= min_recall, F.col("threshold"))).alias("__by_recall"), best.alias("__best")
    )
    f1_optimal = -F.col("__best.low")
    return picked.select(
        *keys, F.coalesce("__by_recall", f1_optimal).alias("operating_threshold"), f1_optimal.alias("f1_optimal")
    )


def confusion_metrics(
    df: DataFrame, score: str, label: str, threshold: float | Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold, 0 where undefined; one aggregate."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, actual = F.col(score) >= limit, F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(hit & actual).alias("tp"),
        F.count_if(hit & ~actual).alias("fp"),
        F.count_if(~hit & actual).alias("fn"),
        F.count_if(~hit & ~actual).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return counts.select(
        *keys, "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def replay_metrics(
    df: DataFrame, score: str, label: str, threshold: float, keys: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """The five metrics of a replay: accuracy, precision, recall, F1 and ROC AUC."""
    at_threshold = confusion_metrics(df, score, label, threshold, keys).drop("tp", "fp", "fn", "tn")
    area = roc_auc(df, score, label, keys, buckets)
    joined = at_threshold.join(area, list(keys)) if keys else at_threshold.join(F.broadcast(area), F.lit(True))
    return joined.withColumn("threshold", F.lit(float(threshold)))


def max_abs_diff(left: DataFrame, right: DataFrame, ids: Sequence[str], score: str = "probability", tolerance: float = 1e-12) -> DataFrame:
    """Greatest absolute score difference of two scorings over all rows, and rows only one side has."""
    other = right.select(*ids, F.col(score).alias("__other"))
    joined = left.select(*ids, score).join(other, list(ids), "full_outer")
    lonely = F.col(score).isNull() | F.col("__other").isNull()
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(lonely).alias("unmatched"),
        F.max(F.abs(F.col(score) - F.col("__other"))).alias("max_abs_diff"),
    ).withColumn("within", (F.coalesce("max_abs_diff", F.lit(0.0)) <= tolerance) & (F.col("unmatched") == 0))


def select_best_candidate(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Candidate with the greatest validation F1; the first (``ordinal``) on ties."""
    best = F.max_by(F.struct(*[c for c in metrics.columns if c not in keys]), F.struct("val_f1", -F.col("ordinal")))
    return metrics.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")
