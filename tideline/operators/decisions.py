"""Alerts, investigations, approvals and dispatch as set-at-a-time table operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.severity import should_act
from tideline.operators.graph import components
from tideline.operators.ordered import previous_value
from tideline.session import cut
from tideline.sources.tables import upsert_latest

# Ship the greedy choice with the task; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ACTIONS = ("replay_test", "retrain", "rollback")  # actions that reach the job queue
DISPATCH_TTL_SECONDS = 86_400


def idempotency_key(action: Column, investigation: Column) -> Column:
    return F.concat_ws(":", action, investigation.cast("string"))


def event_id(key: Column, report_id: Column) -> Column:
    """Deterministic id, so that a replayed report gives the same event."""
    return F.md5(F.concat_ws("|", key, report_id))


def severity_changes(
    reports: DataFrame, keys: Sequence[str], ts: str = "ts", report_id: str = "report_id", rows: int | None = None
) -> DataFrame:
    """Reports whose severity differs from the one before; the first report of a key always counts."""
    lagged = previous_value(reports, keys, ts, report_id, "severity", "previous_severity", rows)
    return lagged.where(~F.col("previous_severity").eqNullSafe(F.col("severity")))


def propose_action(df: DataFrame, severity: str = "severity", features: str = "drifted_features") -> DataFrame:
    """Remediation rule: ``action, rationale, requires_hil, priority, should_act``."""
    level = F.col(severity)
    names = F.concat(F.lit("["), F.array_join(F.transform(features, lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", "), F.lit("]"))
    acts = level != "low"
    return df.withColumns(
        {
            "action": F.when(level == "low", "no_action").when(level == "high", "retrain").otherwise("replay_test"),
            "rationale": F.when(~acts, "Severity too low to warrant intervention.").otherwise(
                F.concat(F.lit("Severity="), level, F.lit(". Features drifted: "), names, F.lit("."))
            ),
            "requires_hil": acts,
            "priority": level,
            "should_act": should_act(level),
        }
    )


def drifted_features(psi_results: Column, limit: int = 5) -> Column:
    """Features at medium or high, in report order."""
    hit = F.filter(psi_results, lambda r: should_act(r["severity"]))
    return F.slice(F.transform(hit, lambda r: r["feature"]), 1, limit)


def significant(value: Column, digits: int = 6) -> Column:
    """Number with ``digits`` significant digits, no trailing zeros, exponent outside 1e-4 .. 10**digits."""
    sci = F.format_string(f"%.{digits - 1}e", value)
    exponent = F.when(value == 0, F.lit(0)).otherwise(F.split_part(sci, F.lit("e"), F.lit(2)).cast("int"))
    trim = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.lit(None)
    for e in range(-4, digits):
        plain = F.when(exponent == e, trim(F.format_string(f"%.{digits - 1 - e}f", value))).otherwise(plain)
    return F.coalesce(plain, F.concat(trim(F.split_part(sci, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(sci, F.lit("e"), F.lit(2))))


def severity_text(previous: Column, severity: Column, model: Column, version: Column) -> Column:
    return F.concat(
        F.lit("Drift severity changed from "), F.coalesce(previous, F.lit("none")), F.lit(" to "), severity,
        F.lit(" for "), model, F.lit(" v"), version.cast("string"), F.lit("."),
    )


def feature_list_text(top: Column) -> Column:
    """``f=value (severity), ...`` or ``none``."""
    text = F.array_join(
        F.transform(top, lambda t: F.concat(t["feature"], F.lit("="), significant(t["value"]), F.lit(" ("), t["severity"], F.lit(")"))), ", "
    )
    return F.when(F.coalesce(F.size(top), F.lit(0)) > 0, text).otherwise("none")


def metadata_prefix(pairs: dict[str, Column]) -> Column:
    """``k=v, k=v`` in the given order."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in pairs.items()])


def alert_summary(events: DataFrame, out: str = "summary") -> DataFrame:
    """Initial summary of an investigation from an alert event."""
    pairs = {
        "severity": F.col("severity"),
        "previous_severity": F.coalesce("previous_severity", F.lit("none")),
        "model_name": F.col("model_name"),
        "model_version": F.col("model_version"),
        "report_id": F.col("report_id"),
        "event_id": F.col("event_id"),
        "top_features": feature_list_text(F.col("top_features")),
    }
    change = severity_text(F.col("previous_severity"), F.col("severity"), F.col("model_name"), F.col("model_version"))
    return events.withColumn(out, F.concat(F.lit("Drift event received: "), metadata_prefix(pairs), F.lit(". "), change))


def extract_field(summary: Column, name: str) -> Column:
    """Value of ``name=...`` up to a comma, a dot or white space."""
    found = F.nullif(F.regexp_extract(summary, rf"\Q{name}\E=([^,\.\s]+)", 1), F.lit(""))
    return F.coalesce(found, F.lit("Not available"))


def matched_investigations(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Events that already have an investigation by event id or report id; the earliest one wins."""
    fields = F.struct("created_at", "id")
    by_event = existing.groupBy(F.col("drift_event_id").alias("event_id")).agg(F.min(fields).alias("by_event"))
    by_report = existing.groupBy(F.col("drift_report_id").alias("report_id")).agg(F.min(fields).alias("by_report"))
    return (
        events.join(by_event, "event_id", "left")
        .join(by_report, "report_id", "left")
        .withColumn("investigation_id", F.least("by_event", "by_report")["id"])
        .where(F.col("investigation_id").isNotNull())
        .drop("by_event", "by_report")
    )


#: Rounds go on while each decides this share of what is open; what then remains are long chains.
MIN_PROGRESS = 0.25
#: Events of a slice of long chains; no task holds the ids of more.
SLICE_EVENTS = 200_000


def open_investigations(existing: DataFrame, events: DataFrame, ts: str = "created_at") -> DataFrame:
    """Events that open a new investigation, as if taken one by one in (time, event, report) order.

    An event is refused if its event id or report id belongs to an existing or an already accepted
    row; a NULL id never matches. In each round every undecided event that comes first for both of its
    ids is accepted, and the events sharing an id with it are refused. Where rounds decide little, events
    hang together in chains, which have an order that nothing shortens: then the events are cut by order into
    slices, ids used in earlier slices are taken out of later ones by anti-joins, and inside a slice each
    group of connected events is taken in order by one task, all groups side by side.
    """
    names = [c for c in events.columns if c not in (ts, "event_id", "report_id")]
    unmatched = (
        events.join(existing.select(F.col("drift_event_id").alias("event_id")).where("event_id is not null").distinct(), "event_id", "left_anti")
        .join(existing.select(F.col("drift_report_id").alias("report_id")).where("report_id is not null").distinct(), "report_id", "left_anti")
        .select(*events.columns)
    )
    without_ids = unmatched.where("event_id is null and report_id is null")
    pairs = (
        # full copies and repeats of one (event, report) pair can never both be accepted
        unmatched.where("event_id is not null or report_id is not null")
        .groupBy("event_id", "report_id")
        .agg(F.min(F.struct(ts, *names)).alias("r"))
        .select("event_id", "report_id", f"r.{ts}")
        # a missing id gets a name that only rows with the same other id share
        .withColumn("__e", F.coalesce(F.concat(F.lit("e"), F.col("event_id").cast("string")), F.concat(F.lit("r"), F.col("report_id").cast("string"))))
        .withColumn("__r", F.coalesce(F.concat(F.lit("R"), F.col("report_id").cast("string")), F.concat(F.lit("E"), F.col("event_id").cast("string"))))
        .withColumn("__o", F.struct(ts, "event_id", "report_id"))
    )
    undecided = cut(pairs.select("__e", "__r", "__o"))
    open_rows = undecided.count()
    accepted = [undecided.limit(0)]
    while open_rows:
        first_e = undecided.groupBy("__e").agg(F.min("__o").alias("__fe"))
        first_r = undecided.groupBy("__r").agg(F.min("__o").alias("__fr"))
        taken = cut(undecided.join(first_e, "__e").join(first_r, "__r").where((F.col("__o") == F.col("__fe")) & (F.col("__o") == F.col("__fr"))).select("__e", "__r", "__o"))
        accepted.append(taken)
        undecided = cut(undecided.join(taken.select("__e"), "__e", "left_anti").join(taken.select("__r"), "__r", "left_anti"))
        before, open_rows = open_rows, undecided.count()
        if open_rows > (1 - MIN_PROGRESS) * before:
            accepted.append(_take_in_order(undecided, open_rows))
            break
    chosen = reduce(DataFrame.unionByName, accepted).select(F.col("__o.event_id").alias("__i"), F.col("__o.report_id").alias("__j"))
    same = F.col("event_id").eqNullSafe(F.col("__i")) & F.col("report_id").eqNullSafe(F.col("__j"))
    rows = unmatched.join(chosen, same, "left_semi").groupBy("event_id", "report_id").agg(F.min(F.struct(ts, *names)).alias("r"))
    return rows.select("event_id", "report_id", "r.*").select(*events.columns).unionByName(without_ids)


def _take_in_order(undecided: DataFrame, open_rows: int) -> DataFrame:
    """Greedy choice by order, slice after slice; a slice and so a task's group has about SLICE_EVENTS rows at most.

    Slices are decided by halves: what the first half accepts is taken out of the second half once, so that every
    event is moved as often as the logarithm of the number of slices.
    """
    slices = -(-open_rows // SLICE_EVENTS)
    placed = undecided.repartitionByRange(slices, "__o").withColumn("__slice", F.spark_partition_id()) if slices > 1 else undecided.withColumn("__slice", F.lit(0))

    def decide(rows: DataFrame, low: int, high: int) -> DataFrame:
        if high - low == 1:
            return cut(_take_slice(rows))
        middle = (low + high) // 2
        first = decide(rows.where(F.col("__slice") < middle), low, middle)
        rest = rows.where(F.col("__slice") >= middle)
        rest = cut(rest.join(first.select("__e"), "__e", "left_anti").join(first.select("__r"), "__r", "left_anti").select(*rows.columns))
        return first.unionByName(decide(rest, middle, high))

    fixed = cut(placed)
    return decide(fixed, 0, (fixed.agg(F.max("__slice")).first()[0] or 0) + 1)


def _take_slice(rows: DataFrame) -> DataFrame:
    groups = components(rows.select(F.col("__e").alias("a"), F.col("__r").alias("b")))
    kind = rows.schema["__o"].dataType.simpleString()
    ordered = rows.join(groups.withColumnRenamed("node", "__e"), "__e").select("root", "__e", "__r", "__o").repartition("root").sortWithinPartitions("root", "__o")
    return ordered.mapInArrow(_greedy, f"__e string, __r string, __o {kind}")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root, used = None, set()
    for batch in batches:
        keep = []
        for i, (group, e, r) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)])):
            if group != root:
                root, used = group, set()
            if e not in used and r not in used:
                used.update((e, r))
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (1, 2, 3)], ["__e", "__r", "__o"])


def dedupe_dispatch(
    dispatches: DataFrame,
    key: str = "idempotency_key",
    ts: str = "ts",
    tie: str = "id",
    ttl_seconds: int = DISPATCH_TTL_SECONDS,
) -> DataFrame:
    """Accepted dispatches: at most one per key within the TTL of the last accepted one.

    After an accepted row the next one is the first at or after its time plus the TTL. This successor is
    found for all rows at once, within slices of one TTL, so a hot key is cut by time. A row
    without another in the TTL before it is accepted for sure; from those rows the successors are followed,
    twice as far in each round, so the rounds are the logarithm of the longest unbroken run.
    ``key`` and ``tie`` together identify a row; rows without a time are not accepted.
    """
    ttl = ttl_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # rows equal in key and time: only the first can be accepted
    rows = cut(dispatches.select(F.col(key).alias("k"), at.alias("t"), F.col(tie).alias("tie")).where("t is not null").groupBy("k", "t").agg(F.min("tie").alias("tie")))
    data = rows.select("k", "t", F.col("t").alias("at"), F.lit(1).alias("real"))
    probes = rows.select("k", "t", (F.col("t") + ttl).alias("at"), F.lit(0).alias("real"))
    both = data.unionByName(probes).withColumn("slice", F.expr(f"at div {ttl} - if(at % {ttl} < 0, 1, 0)"))
    time = F.when(F.col("real") == 1, F.col("at"))
    down = W.partitionBy("k", "slice").orderBy(F.col("at").desc(), F.col("real").desc())
    up = W.partitionBy("k", "slice").orderBy(F.col("at").asc(), F.col("real").desc())
    # a row at the time of a probe is its successor; only rows before a row count for the gap
    seen = both.withColumn("after", F.last(time, True).over(down.rowsBetween(W.unboundedPreceding, 0)))
    seen = seen.withColumn("before", F.last(time, True).over(up.rowsBetween(W.unboundedPreceding, -1)))
    slices = both.groupBy("k", "slice").agg(F.min(time).alias("low"), F.max(time).alias("high"))
    later = W.partitionBy("k").orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("k").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    edges = slices.select("k", "slice", F.last("low", True).over(later).alias("low"), F.last("high", True).over(earlier).alias("high"))
    placed = cut(seen.join(edges, ["k", "slice"]).select("k", "t", "real", F.coalesce("after", "low").alias("after"), F.coalesce("before", "high").alias("before")))
    starts = placed.where((F.col("real") == 1) & (F.col("before").isNull() | (F.col("t") - F.col("before") >= ttl))).select("k", "t")
    hops = placed.where((F.col("real") == 0) & F.col("after").isNotNull()).select("k", "t", F.col("after").alias("next"))
    hops = cut(hops.join(starts.withColumnRenamed("t", "next"), ["k", "next"], "left_anti").select("k", "t", "next"))
    reached = cut(starts)
    while not hops.isEmpty():
        further = reached.join(hops, ["k", "t"]).select("k", F.col("next").alias("t"))
        reached = cut(reached.unionByName(further).distinct())
        onward = hops.select("k", F.col("t").alias("next"), F.col("next").alias("onward"))
        hops = cut(hops.join(onward, ["k", "next"]).select("k", "t", F.col("onward").alias("next")))
    taken = reached.join(rows, ["k", "t"]).select(F.col("k").alias(key), F.col("tie").alias(tie))
    return dispatches.join(taken, [key, tie], "left_semi")


def pending_approvals(approvals: DataFrame, investigations: DataFrame, limit: int = 50) -> DataFrame:
    """Newest pending approvals with their investigation."""
    inv = investigations.select(
        F.col("id").alias("investigation_id"), F.col("status").alias("investigation_status"), "drift_report_id"
    )
    pending = approvals.where(F.col("status") == "pending").join(inv, "investigation_id")
    return pending.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def valid_approvals(proposals: DataFrame, approvals: DataFrame) -> DataFrame:
    """Add ``approval_valid``: an approved row exists that matches investigation, action and version."""
    good = (
        approvals.where((F.col("status") == "approved") & (F.col("decision") == "approved"))
        .select(
            F.col("id").alias("hil_approval_id"), "investigation_id", "action",
            F.col("model_version"), F.lit(True).alias("__ok"),
        )
        .distinct()
    )
    checked = proposals.join(good, ["hil_approval_id", "investigation_id", "action", "model_version"], "left")
    ok = F.coalesce("__ok", F.lit(False)) & F.col("action").isin(*ACTIONS)
    return checked.withColumn("approval_valid", ok).drop("__ok").select(*proposals.columns, "approval_valid")


def latest_reports(reports: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Last report per key: ``keys, current_report_id, current_severity``."""
    return (
        reports.groupBy(*keys)
        .agg(F.max_by(F.struct("report_id", "severity"), F.struct(ts, "report_id")).alias("r"))
        .select(*keys, F.col("r.report_id").alias("current_report_id"), F.col("r.severity").alias("current_severity"))
    )


def stale_investigations(investigations: DataFrame, reports: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Add ``stale``: the latest report is another one and its severity differs as well."""
    joined = investigations.join(latest_reports(reports, keys, ts), list(keys), "left")
    stale = (F.col("drift_report_id") != F.col("current_report_id")) & (F.col("severity") != F.col("current_severity"))
    return joined.withColumn("stale", F.coalesce(stale, F.lit(False)))


def reconciled_versions(df: DataFrame, versions: DataFrame, model: str = "model_name", version: str = "model_version") -> DataFrame:
    """Add ``resolved_version``: the stored version if it exists, else Production, else NULL."""
    known = versions.select(F.col("model").alias(model), F.col("version").alias(version), F.lit(True).alias("__known")).distinct()
    production = (
        versions.where(F.col("stage") == "Production").groupBy(F.col("model").alias(model)).agg(F.max("version").alias("__prod"))
    )
    return (
        df.join(known, [model, version], "left")
        .join(production, model, "left")
        .withColumn("resolved_version", F.when(F.col("__known"), F.col(version)).otherwise(F.col("__prod")))
        .withColumn("unresolved", F.col("resolved_version").isNull())
        .select(*df.columns, "resolved_version", "unresolved")
    )


def recent_investigations(investigations: DataFrame, limit: int = 50) -> DataFrame:
    return investigations.orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(limit)


def apply_decisions(
    approvals: DataFrame, investigations: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Approvals and investigations after decision events.

    A decision (``approval_id, investigation_id, decision, decided_at``) counts only where both ids
    match; the last one per approval wins. Any rejection that names an investigation resolves it.
    """
    last = decisions.groupBy(F.col("approval_id").alias("id"), "investigation_id").agg(
        F.max(F.struct("decided_at", "decision")).alias("__d")
    )
    new_approvals = approvals.join(last, ["id", "investigation_id"], "left").select(
        *[
            {
                "status": F.coalesce("__d.decision", F.col("status")).alias("status"),
                "decision": F.coalesce("__d.decision", F.col("decision")).alias("decision"),
                "decided_at": F.coalesce("__d.decided_at", F.col("decided_at")).alias("decided_at"),
            }.get(c, F.col(c))
            for c in approvals.columns
        ]
    )
    rejected = (
        decisions.where(F.col("decision") == "rejected")
        .groupBy(F.col("investigation_id").alias("id"))
        .agg(F.max("decided_at").alias("__at"))
    )
    new_investigations = investigations.join(rejected, "id", "left").select(
        *[
            {
                "status": F.when(F.col("__at").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"),
                "updated_at": F.greatest("updated_at", "__at").alias("updated_at"),
            }.get(c, F.col(c))
            for c in investigations.columns
        ]
    )
    return new_approvals, new_investigations


def apply_events(state: DataFrame, events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current state of an event-sourced table: the latest row per key wins."""
    return upsert_latest(state, events, key, order)


def dispatch_plan(proposals: DataFrame, approvals: DataFrame, reports: DataFrame, versions: DataFrame, report_keys: Sequence[str]) -> DataFrame:
    """Outcome per proposal: skipped, blocked with the first failing reason, or enqueued."""
    checked = valid_approvals(proposals, approvals)
    checked = stale_investigations(checked, reports, report_keys)
    checked = reconciled_versions(checked, versions)
    reason = (
        F.when(~F.col("action").isin(*ACTIONS), "no_action")
        .when(F.col("requires_hil") & ~F.col("approval_valid"), "approval_invalid")
        .when(F.col("stale"), "stale")
        .when(F.col("unresolved"), "unreconciled")
    )
    return checked.withColumn("reason", reason).withColumn(
        "dispatch_status", F.when(reason == "no_action", "skipped").when(reason.isNotNull(), "blocked").otherwise("enqueued")
    )
