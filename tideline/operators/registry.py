"""Model versions, promotion gates and stage changes as tables.

A version row is ``model, version, stage, run_id, tags, created_at``; tags are texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_RECALL = 0.75


def tag(name: str, kind: str = "double") -> Column:
    """Numeric tag; missing or empty reads as 0."""
    return F.coalesce(F.element_at("tags", name).try_cast(kind), F.lit(0).cast(kind))


def registry_summary(versions: DataFrame) -> DataFrame:
    return versions.select(
        "model",
        F.col("version").cast("int").alias("version"),
        "stage",
        "run_id",
        tag("auc").alias("auc"),
        tag("recall").alias("recall"),
        tag("operating_threshold").alias("threshold"),
    )


def latest_version_per_stage(versions: DataFrame) -> DataFrame:
    """Highest integer version per model and stage; an aggregate, so no key is sorted."""
    rest = [c for c in versions.columns if c not in ("model", "stage")]
    return (
        versions.groupBy("model", "stage")
        .agg(F.max_by(F.struct(*rest), F.col("version").cast("int")).alias("r"))
        .select("model", "stage", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def serving_version(versions: DataFrame) -> DataFrame:
    """Production, else Staging: ``model, version, stage, threshold``; models with neither are left out.

    The threshold is the tag, or the run parameter ``run_threshold`` where the table has one.
    """
    run_threshold = F.col("run_threshold") if "run_threshold" in versions.columns else F.lit(None).cast("double")
    ready = versions.where(F.col("stage").isin("Production", "Staging"))
    priority = F.struct((F.col("stage") == "Production").cast("int"), F.col("version").cast("int"))
    picked = F.struct(
        F.col("version").cast("int").alias("version"),
        "stage",
        F.coalesce(F.element_at("tags", "operating_threshold").try_cast("double"), run_threshold).alias("threshold"),
    )
    return ready.groupBy("model").agg(F.max_by(picked, priority).alias("r")).select("model", "r.*")


def _production(versions: DataFrame) -> DataFrame:
    prod = latest_version_per_stage(versions.where(F.col("stage") == "Production"))
    return prod.select("model", F.col("version").cast("int").alias("production_version"), tag("auc").alias("production_auc"))


def promotion_gates(
    requests: DataFrame,
    versions: DataFrame,
    approvals: DataFrame | None = None,
    newer_drift: DataFrame | None = None,
    min_recall: float = MIN_RECALL,
    enforced: tuple[bool, bool, bool, bool, bool] = (True, True, True, False, True),
) -> DataFrame:
    """All gates of a promotion request as columns, and the first failing enforced one as ``reason``.

    Gates: target exists in Staging; AUC not below Production; recall floor; no newer drift of higher
    severity (``newer_drift``: investigation_id); approval recorded (id given, and known if
    ``approvals`` is given). By default the fourth gate is reported but not enforced.
    """
    target = versions.select(
        F.col("model").alias("model_name"), F.col("version").cast("int").alias("target_version"), F.col("stage").alias("target_stage"),
        tag("auc").alias("target_auc"), tag("recall").alias("target_recall"),
    )
    joined = requests.join(target, ["model_name", "target_version"], "left").join(
        _production(versions).withColumnRenamed("model", "model_name"), "model_name", "left"
    )
    if newer_drift is None:
        joined = joined.withColumn("__newer", F.lit(False))
    else:
        marks = newer_drift.select("investigation_id").distinct().withColumn("__newer", F.lit(True))
        joined = joined.join(marks, "investigation_id", "left")
    given = F.coalesce(F.length("hil_approval_id") > 0, F.lit(False))
    if approvals is not None:
        known = approvals.select(F.col("id").alias("hil_approval_id")).distinct().withColumn("__known", F.lit(True))
        joined = joined.join(known, "hil_approval_id", "left")
        given = given & F.coalesce("__known", F.lit(False))
    gates = {
        "gate_staging": F.coalesce(F.col("target_stage") == "Staging", F.lit(False)),
        "gate_auc": F.coalesce(F.col("target_auc") >= F.coalesce("production_auc", F.lit(float("-inf"))), F.lit(False)),
        "gate_recall": F.coalesce(F.col("target_recall") >= min_recall, F.lit(False)),
        "gate_drift": ~F.coalesce("__newer", F.lit(False)),
        "gate_approval": given,
    }
    checked = joined.withColumns(gates)
    names = ("not_found", "not_staging", "auc_below_production", "recall_below_minimum", "newer_drift", "approval_missing")
    failing = [
        (F.col("target_stage").isNull(), enforced[0]),
        (~F.col("gate_staging"), enforced[0]),
        (~F.col("gate_auc"), enforced[1]),
        (~F.col("gate_recall"), enforced[2]),
        (~F.col("gate_drift"), enforced[3]),
        (~F.col("gate_approval"), enforced[4]),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(n)) for n, (bad, on) in zip(names, failing) if on])
    return checked.withColumn("reason", reason).select(
        *requests.columns, "target_stage", "target_auc", "target_recall", "production_version", "production_auc",
        *gates, "reason", reason.isNull().alias("promoted"),
    )


def apply_promotion(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """Registry after promotions (``model_name, promoted_version``): target to Production, old one archived.

    Several promotions of one model are taken in version order, so the greatest ends in Production.
    """
    last = promotions.groupBy(F.col("model_name").alias("model")).agg(
        F.max("promoted_version").alias("__to"), F.collect_set("promoted_version").alias("__all")
    )
    version = F.col("version").cast("int")
    stage = (
        F.when(version == F.col("__to"), "Production")
        .when(F.col("__to").isNotNull() & ((F.col("stage") == "Production") | F.array_contains("__all", version)), "Archived")
        .otherwise(F.col("stage"))
    )
    return versions.join(last, "model", "left").withColumn("stage", stage).select(*versions.columns)


def register_staging(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Registry after registering new Staging versions: older Staging versions are archived."""
    incoming = new.groupBy("model").agg(F.max(F.col("version").cast("int")).alias("__new"))
    archived = versions.join(incoming, "model", "left").withColumn(
        "stage", F.when(F.col("__new").isNotNull() & (F.col("stage") == "Staging"), "Archived").otherwise(F.col("stage"))
    )
    return archived.select(*versions.columns).unionByName(new.withColumn("stage", F.lit("Staging")).select(*versions.columns))


def promotion_events(gates: DataFrame, created_at: Column) -> DataFrame:
    """Audit rows of the requests that passed."""
    return gates.where("promoted").select(
        F.md5(F.concat_ws("|", "model_name", F.col("target_version").cast("string"), "investigation_id")).alias("id"),
        "model_name",
        F.col("target_version").alias("promoted_version"),
        F.col("production_version").alias("previous_version"),
        "investigation_id",
        created_at.alias("created_at"),
    )


def promotion_eligibility(versions: DataFrame, min_recall: float = MIN_RECALL) -> DataFrame:
    """Badge per model with a Staging version: eligible, below_recall or auc_regression."""
    staging = latest_version_per_stage(versions.where(F.col("stage") == "Staging")).select(
        "model", F.col("version").cast("int").alias("staging_version"), tag("auc").alias("staging_auc"), tag("recall").alias("staging_recall")
    )
    joined = staging.join(_production(versions), "model", "left")
    badge = (
        F.when(F.col("staging_recall") < min_recall, "below_recall")
        .when(F.col("staging_auc") < F.col("production_auc"), "auc_regression")
        .otherwise("eligible")
    )
    return joined.withColumn("badge", badge)


def retrain_decision(candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """``request_promotion`` if a new test AUC (``model, new_auc``) reaches Production (0 if none), else ``keep``."""
    joined = candidates.join(_production(versions), "model", "left")
    floor = F.coalesce("production_auc", F.lit(0.0))
    return joined.withColumn("decision", F.when(F.col("new_auc") >= floor, "request_promotion").otherwise("keep"))
