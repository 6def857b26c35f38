"""Drift metrics: PSI, chi-squared goodness of fit, output drift, reports and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.severity import (
    CHI2_ALPHA,
    PSI_HIGH,
    PSI_WARN,
    chi2_severity,
    highest_severity,
    psi_severity,
    severity_rank,
)
from tideline.functions.stats import chi2_p_value
from tideline.operators.profile import (
    BINS,
    ReferenceProfile,
    bin_of,
    category_counts,
    histogram,
    present,
)
from tideline.operators.quantiles import finite_or_null
from tideline.session import cut

EPSILON = 1e-8
FLOOR = 1e-8  # of expected counts


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def _psi_value(ref_counts: Column, cur_counts: Column, epsilon: float) -> Column:
    def shares(counts: Column) -> Column:
        total = _sum(counts) + F.lit(epsilon)
        return F.transform(counts, lambda c: c / total + F.lit(epsilon))

    terms = F.zip_with(shares(ref_counts), shares(cur_counts), lambda r, c: (c - r) * F.log(c / r))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def psi_from_counts(
    numeric: DataFrame,
    counts: DataFrame,
    keys: Sequence[str] = (),
    epsilon: float = EPSILON,
    warn: float = PSI_WARN,
    high: float = PSI_HIGH,
    profile_keys: Sequence[str] = (),
) -> DataFrame:
    """PSI rows from dense histograms (``keys, feature, current_n, bin_counts``)."""
    ref = numeric.select(*profile_keys, "feature", F.col("n").alias("reference_n"), F.col("bin_counts").alias("ref_counts"))
    if not profile_keys:  # one row per column of the schema
        ref = F.broadcast(ref)
    joined = counts.join(ref, [*profile_keys, "feature"]).withColumn(
        "psi", _psi_value(F.col("ref_counts"), F.col("bin_counts"), epsilon)
    )
    return joined.select(
        *keys, "feature", "psi", psi_severity(F.col("psi"), warn, high).alias("severity"), "reference_n", "current_n"
    )


def psi(
    profile: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    bins: int = BINS,
    epsilon: float = EPSILON,
    warn: float = PSI_WARN,
    high: float = PSI_HIGH,
    profile_keys: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Population stability index per (key and) numeric feature.

    ``profile`` is the ``numeric`` table of a reference profile made with the same ``bins``. With
    ``strict`` an empty side is an error; otherwise it gives no rows.
    """
    if strict and (profile.isEmpty() or current.isEmpty()):
        raise ValueError("reference and current must be non-empty")
    counts = histogram(current, profile, features, bins, keys, profile_keys)
    return psi_from_counts(profile, counts, keys, epsilon, warn, high, profile_keys)


def chi2_from_counts(
    categorical: DataFrame,
    counts: DataFrame,
    keys: Sequence[str] = (),
    alpha: float = CHI2_ALPHA,
    profile_keys: Sequence[str] = (),
) -> DataFrame:
    """Goodness-of-fit rows from ``keys, feature, category, count``.

    Only reference categories are compared, but unseen and missing values stay in the window size, so
    they raise every expected count. With e = n * freq the statistic is sum(o^2 / e) - 2 sum(o) + sum(e), where
    the first two run over observed categories only: no grid of keys and categories is built. Expected
    counts below the floor need a look at each frequency below it; those are grouped by value.
    """
    floored = F.when(F.col("freq") < FLOOR, F.col("freq"))  # n is 1 at least, so others stay above the floor
    o, part = F.col("count").cast("double"), [*profile_keys, "feature"]
    reference = (
        categorical.groupBy(*part, floored.alias("low"))
        .agg(F.sum("freq").alias("mass"), F.count(F.lit(1)).alias("k"))
        .groupBy(*part)
        .agg(F.sum("mass").alias("__mass"), F.sum("k").alias("__k"), F.collect_list(F.when(F.col("low").isNotNull(), F.struct("low", "k"))).alias("__low"))
    )
    if not profile_keys:  # one row per column of the schema
        reference = F.broadcast(reference)
    seen = (
        counts.join(categorical.select(*part, "category", "freq"), [*part, "category"], "left")
        .groupBy(*keys, "feature", floored.alias("low"))
        .agg(
            F.sum("count").alias("n"), F.sum(F.when(F.col("freq") >= FLOOR, o * o / F.col("freq"))).alias("a"),
            F.sum(F.when(F.col("freq").isNotNull(), o)).alias("b"), F.sum(o * o).alias("squares"),
        )
        .groupBy(*keys, "feature")
        .agg(
            F.sum("n").alias("current_n"), F.coalesce(F.sum("a"), F.lit(0.0)).alias("__a"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("__b"),
            F.collect_list(F.when(F.col("low").isNotNull(), F.struct("low", "squares"))).alias("__seen"),
        )
    )
    n = F.col("current_n")
    at_least = lambda freq: F.greatest(freq * n, F.lit(FLOOR))
    low_seen = F.aggregate("__seen", F.lit(0.0), lambda t, x: t + x["squares"] / at_least(x["low"]))
    lifted = F.aggregate("__low", F.lit(0.0), lambda t, x: t + x["k"] * (at_least(x["low"]) - x["low"] * n))
    stats = (
        seen.join(reference, part)
        .withColumn("statistic", F.greatest(F.col("__a") / n + low_seen - 2 * F.col("__b") + n * F.col("__mass") + lifted, F.lit(0.0)))
        .withColumn("dof", F.greatest(F.col("__k") - 1, F.lit(1)).cast("int"))
        .withColumn("p_value", chi2_p_value("statistic", "dof"))
    )
    return stats.select(
        *keys,
        "feature",
        "statistic",
        "p_value",
        "dof",
        chi2_severity(F.col("p_value"), alpha).alias("severity"),
        F.floor(F.col("__mass") * F.col("current_n")).alias("reference_n"),
        "current_n",
    )


def chi2(
    categorical: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    alpha: float = CHI2_ALPHA,
    profile_keys: Sequence[str] = (),
) -> DataFrame:
    """Chi-squared goodness of fit per (key and) categorical feature."""
    return chi2_from_counts(categorical, category_counts(current, features, keys), keys, alpha, profile_keys)


def _two_class_psi(ref_one: Column, cur_one: Column) -> Column:
    def term(r: Column, c: Column) -> Column:
        return (c - r) * F.log(c / r)

    e = F.lit(EPSILON)
    return term((1 - ref_one) + e, (1 - cur_one) + e) + term(ref_one + e, cur_one + e)


def _legacy_two_bin_psi(ref_one: Column, zeros: Column, ones: Column) -> Column:
    """PSI of labels against a stand-in series of 100 zeros and int(100 * rate) ones, two bins.

    The median edge is 0 unless the rate is 1, so normally one bin holds everything.
    """
    extra = F.floor(ref_one * 100).cast("long")
    halves = extra >= 100
    ref = F.array(F.when(halves, F.lit(100)).otherwise(F.lit(0)).cast("long"), F.when(halves, extra).otherwise(extra + 100))
    cur = F.array(F.when(halves, zeros).otherwise(F.lit(0)).cast("long"), F.when(halves, ones).otherwise(zeros + ones).cast("long"))
    return _psi_value(ref, cur, EPSILON)


def output_from_counts(
    output: DataFrame,
    counts: DataFrame,
    keys: Sequence[str] = (),
    mode: str = "proportions",
    warn: float = PSI_WARN,
    high: float = PSI_HIGH,
    profile_keys: Sequence[str] = (),
) -> DataFrame:
    """Output drift from ``keys, zeros, ones, current_n``."""
    if mode not in ("proportions", "compat"):
        raise ValueError(f"unknown output drift mode: {mode}")
    ref = output.where(F.col("class") == "1").select(*profile_keys, F.col("share").alias("reference_class_1_rate"))
    if profile_keys:
        joined = counts.join(ref, list(profile_keys))
    else:  # the single share of class 1
        joined = counts.join(F.broadcast(ref), F.lit(True), "left")
    ref_one = F.coalesce("reference_class_1_rate", F.lit(0.0))
    cur_one = F.coalesce(F.col("ones") / F.nullif(F.col("zeros") + F.col("ones"), F.lit(0)), F.lit(0.0))
    value = (
        _two_class_psi(ref_one, cur_one) if mode == "proportions" else _legacy_two_bin_psi(ref_one, F.col("zeros"), F.col("ones"))
    )
    value = F.when(F.col("current_n") == 0, F.lit(0.0)).otherwise(value)
    return joined.withColumn("psi", value).select(
        *keys,
        "psi",
        psi_severity(F.col("psi"), warn, high).alias("severity"),
        ref_one.alias("reference_class_1_rate"),
        cur_one.alias("current_class_1_rate"),
        "current_n",
    )


def output_drift(
    output: DataFrame,
    current: DataFrame,
    label: Column,
    keys: Sequence[str] = (),
    mode: str = "proportions",
    profile_keys: Sequence[str] = (),
) -> DataFrame:
    """Shift of the predicted class. Without keys an empty window gives one low row.

    ``mode="compat"`` keeps a historical formula that hardly reacts (see :func:`_legacy_two_bin_psi`).
    """
    counts = current.groupBy(*keys).agg(
        F.count_if(label == 0).alias("zeros"),
        F.count_if(label == 1).alias("ones"),
        F.count(F.lit(1)).alias("current_n"),
    )
    return output_from_counts(output, counts, keys, mode, profile_keys=profile_keys)


def metric_rows(psi_rows: DataFrame, chi2_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """PSI and chi-squared rows under one schema; ``source`` keeps their order."""
    left = psi_rows.select(
        *keys, "feature", F.lit("psi").alias("metric"), F.col("psi").alias("value"),
        F.lit(None).cast("double").alias("p_value"), "severity", F.lit(0).alias("source"),
    )
    right = chi2_rows.select(
        *keys, "feature", F.lit("chi2").alias("metric"), F.col("statistic").alias("value"),
        "p_value", "severity", F.lit(1).alias("source"),
    )
    return left.unionByName(right)


def aggregate_severity(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Highest severity of any metric row per key; no row at all reads as low, unmeasured rows as NULL
    unless another is above low."""
    unknown = F.count_if(F.col("severity").isNull()) > 0
    return rows.groupBy(*keys).agg(highest_severity(F.max(severity_rank(F.col("severity"))), unknown).alias("severity"))


def _first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Ranked head of a metric table, which has at most one row per column of the schema and key."""
    part = W.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= limit)


def top_drifted_features(rows: DataFrame, keys: Sequence[str] = (), limit: int = 5) -> DataFrame:
    """Alert ranking: severity, then metric value, both descending; PSI before chi2 on ties."""
    order = [severity_rank(F.col("severity")).desc(), F.col("value").desc(), F.col("source").asc(), F.col("feature").asc()]
    return _first_per_key(rows, keys, order, limit).select(*keys, "rank", "feature", "metric", "value", "severity")


def top_features_dashboard(
    rows: DataFrame, keys: Sequence[str] = (), limit: int = 3, compat: bool = False
) -> DataFrame:
    """Dashboard ranking by severity, then PSI or 1 - p. ``compat`` reads p = 0 as 1."""
    p = F.col("p_value")
    if compat:
        p = F.when(p == 0, F.lit(1.0)).otherwise(p)
    is_psi = F.col("metric") == "psi"
    shown = rows.select(
        *keys,
        "feature",
        F.when(is_psi, "PSI").otherwise("Chi-square").alias("type"),
        F.when(is_psi, F.round("value", 4)).otherwise(F.round(p, 6)).alias("value"),
        "severity",
        "source",
        F.when(is_psi, F.col("value")).otherwise(1 - p).alias("__by"),
    )
    order = [severity_rank(F.col("severity")).desc(), F.col("__by").desc(), F.col("source").asc(), F.col("feature").asc()]
    return _first_per_key(shown, keys, order, limit).select(*keys, "rank", "feature", "type", "value", "severity")


def top_psi(psi_rows: DataFrame, keys: Sequence[str] = (), limit: int = 5) -> DataFrame:
    order = [F.col("psi").desc(), F.col("feature").asc()]
    return _first_per_key(psi_rows, keys, order, limit).select(*keys, "rank", "feature", "psi", "severity")


def top_chi2(chi2_rows: DataFrame, keys: Sequence[str] = (), limit: int = 5) -> DataFrame:
    order = [F.col("p_value").asc(), F.col("feature").asc()]
    return _first_per_key(chi2_rows, keys, order, limit).select(*keys, "rank", "feature", "p_value", "severity")


def cell_counts(
    profile: ReferenceProfile,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: Column,
    keys: Sequence[str] = (),
    bins: int = BINS,
    profile_keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, kind, feature, cell, count`` for every bin, category and class of a window.

    One scan and one aggregation serve all three metrics of a report.
    """

    def entry(kind: str, feature: str, value: Column, text: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(feature).alias("feature"),
            value.cast("double").alias("value"),
            text.cast("string").alias("text"),
        )

    none = F.lit(None)
    entries = [entry("num", f, finite_or_null(F.col(f"`{f}`")), none) for f in present(current, numeric)]
    entries += [entry("cat", f, none, F.col(f"`{f}`")) for f in present(current, categorical)]
    entries.append(entry("out", "label", none, label.cast("int")))
    edges = profile.numeric.select(*profile_keys, "feature", "edges")
    if not profile_keys:  # one row per column of the schema
        edges = F.broadcast(edges)
    cell = F.when(F.col("kind") == "num", bin_of(F.col("value"), F.col("edges"), bins).cast("string")).otherwise(F.col("text"))
    return (
        current.select(*keys, F.explode(F.array(*entries)).alias("e"))
        .select(*keys, "e.*")
        .join(edges, [*profile_keys, "feature"], "left")
        .withColumn("cell", cell)
        .groupBy(*keys, "kind", "feature", "cell")
        .count()
    )


def drift_report(
    profile: ReferenceProfile,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: Column,
    keys: Sequence[str] = (),
    mode: str = "proportions",
    bins: int = BINS,
    alpha: float = CHI2_ALPHA,
    all_keys: DataFrame | None = None,
    report_id: Column | None = None,
    profile_keys: Sequence[str] = (),
    as_of: Column | None = None,
) -> DataFrame:
    """One report row per key: ``report_id, severity, window_size, psi_results, chi2_results, output_drift``.

    The window is scanned once; its cell counts (bins, categories, classes) are fixed in shared
    storage and all metrics are read from them. Keys listed in ``all_keys`` (and the single report
    without keys) appear with severity low and size 0 if their window is empty.

    With ``profile_keys`` (some of ``keys``) each key is compared with its own reference; keys without one
    have no report. ``as_of`` adds a column ``timestamp`` and enters the id, so that equal windows at two
    times are two reports.
    """
    keys = list(keys)
    cells = cut(cell_counts(profile, current, numeric, categorical, label, keys, bins, profile_keys))
    of = lambda kind: cells.where(F.col("kind") == kind)
    in_cell = lambda value: F.coalesce(F.sum(F.when(F.col("cell") == value, F.col("count"))), F.lit(0))

    hist = of("num").groupBy(*keys, "feature").agg(
        F.sum("count").alias("current_n"), F.array(*[in_cell(str(i)) for i in range(bins)]).alias("bin_counts")
    )
    psi_rows = psi_from_counts(profile.numeric, hist, keys, profile_keys=profile_keys)
    categories = of("cat").select(*keys, "feature", F.col("cell").alias("category"), "count")
    chi2_rows = chi2_from_counts(profile.categorical, categories, keys, alpha, profile_keys)
    classes = of("out").groupBy(*keys).agg(
        in_cell("0").alias("zeros"), in_cell("1").alias("ones"), F.coalesce(F.sum("count"), F.lit(0)).alias("current_n")
    )
    if keys and all_keys is not None:
        classes = (
            all_keys.select(*keys).distinct().join(classes, keys, "left").na.fill(0, ["zeros", "ones", "current_n"])
        )
    out = output_from_counts(profile.output, classes, keys, mode, profile_keys=profile_keys)

    # Arrays below hold one entry per column of the schema.
    def packed(rows: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    psi_arrays = packed(psi_rows, ["feature", "psi", "severity", "reference_n", "current_n"], "psi_results")
    chi2_arrays = packed(
        chi2_rows, ["feature", "statistic", "p_value", "dof", "severity", "reference_n", "current_n"], "chi2_results"
    )
    outs = out.select(
        *keys,
        F.struct("psi", "severity", "reference_class_1_rate", "current_class_1_rate", "current_n").alias("output_drift"),
    )
    if keys:
        joined = outs.join(psi_arrays, keys, "left").join(chi2_arrays, keys, "left")
    else:  # three single rows
        joined = outs.join(F.broadcast(psi_arrays), F.lit(True), "left").join(F.broadcast(chi2_arrays), F.lit(True), "left")
    for name, fields in (("psi_results", psi_arrays), ("chi2_results", chi2_arrays)):
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(fields.schema[name].dataType)))
    ranks = F.concat(
        F.transform("psi_results", lambda r: severity_rank(r["severity"])),
        F.transform("chi2_results", lambda r: severity_rank(r["severity"])),
        F.array(severity_rank(F.col("output_drift.severity"))),
    )
    time = [] if as_of is None else [as_of.alias("timestamp")]
    ident = report_id if report_id is not None else F.md5(F.to_json(F.struct(*keys, *time, "psi_results", "chi2_results", "output_drift")))
    return joined.select(
        *keys,
        *time,
        ident.alias("report_id"),
        highest_severity(F.array_max(ranks), F.exists(ranks, lambda r: r == 0)).alias("severity"),
        F.col("output_drift.current_n").alias("window_size"),
        "psi_results",
        "chi2_results",
        "output_drift",
    )


def alert_events(changes: DataFrame, limit: int = 5) -> DataFrame:
    """Alert events v1 from reports whose severity changed.

    ``changes`` are reports with ``model_name, model_version, timestamp`` and ``previous_severity``. The top features
    are ranked by severity, value, metric (PSI first) and name.
    """

    def ranked(results: str, metric: str, value: str, source: int) -> Column:
        return F.transform(results, lambda r: F.struct(
            (-severity_rank(r["severity"])).alias("rank"), (-r[value]).alias("down"), F.lit(source).alias("source"), r["feature"].alias("feature"),
            F.lit(metric).alias("metric"), r[value].alias("value"), r["severity"].alias("severity"),
        ))

    ordered = F.array_sort(F.concat(ranked("psi_results", "psi", "psi", 0), ranked("chi2_results", "chi2", "statistic", 1)))
    top = F.transform(F.slice(ordered, 1, limit), lambda t: F.struct(*[t[c].alias(c) for c in ("feature", "metric", "value", "severity")]))
    text = F.concat(F.lit("Drift severity "), F.col("severity"), F.lit(" over "), F.col("window_size").cast("string"), F.lit(" rows."))
    return changes.select(
        F.lit("v1").alias("schema_version"),
        F.md5(F.concat_ws("|", "model_name", F.col("model_version").cast("string"), "report_id")).alias("event_id"),
        "report_id", "previous_severity", "model_name", "model_version", "severity", F.col("timestamp").alias("created_at"),
        F.struct(text.alias("text"), "window_size", F.col("output_drift.severity").alias("output_drift_severity")).alias("drift_summary"),
        top.alias("top_features"), "psi_results", "chi2_results", "output_drift", "window_size",
    )


def exploded_report(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metric rows of reports: ``keys, report_id, report_severity, window_size, feature, metric, value, severity``."""
    rows = F.concat(
        F.transform("psi_results", lambda r: F.struct(r["feature"].alias("feature"), F.lit("psi").alias("metric"), r["psi"].alias("value"), r["severity"].alias("severity"))),
        F.transform("chi2_results", lambda r: F.struct(r["feature"].alias("feature"), F.lit("chi2").alias("metric"), r["statistic"].alias("value"), r["severity"].alias("severity"))),
        F.array(F.struct(F.lit("label").alias("feature"), F.lit("output").alias("metric"), F.col("output_drift.psi").alias("value"), F.col("output_drift.severity").alias("severity"))),
    )
    return report.select(
        *keys, "report_id", F.col("severity").alias("report_severity"), "window_size", F.explode(rows).alias("r")
    ).select(*keys, "report_id", "report_severity", "window_size", "r.*")
