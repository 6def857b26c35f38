from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import decisions as E
from tideline.operators import registry as R
from tideline.sources.tables import upsert_latest

T0 = datetime(2024, 1, 1)
RNG = np.random.default_rng(11)


def at(hours):
    return T0 + timedelta(hours=float(hours))


def test_severity_changes_follow_the_sequence(spark):
    levels = ["low", "low", "medium", "medium", "high", "high", "low"]
    rows = [("m:1", f"r{i}", at(20 * i), s) for i, s in enumerate(levels)] + [("m:2", "x", at(1), "low")]
    out = E.severity_changes(spark.createDataFrame(rows, "key string, report_id string, ts timestamp, severity string"), ["key"])
    got = {(r["key"], r["report_id"]): r["previous_severity"] for r in out.collect()}
    assert got == {("m:1", "r0"): None, ("m:1", "r2"): "low", ("m:1", "r4"): "medium", ("m:1", "r6"): "high", ("m:2", "x"): None}


def greedy_dispatch(df, ttl):
    taken, last = [], {}
    for r in df.sort_values(["ts", "id"]).itertuples():
        if r.idempotency_key not in last or r.ts >= last[r.idempotency_key] + ttl:
            last[r.idempotency_key] = r.ts
            taken.append(r.id)
    return sorted(taken)


def test_dispatch_dedup_equals_the_sequential_fold(spark):
    n = 600
    df = pd.DataFrame(
        {
            "id": np.arange(n),
            "idempotency_key": np.where(RNG.uniform(size=n) < 0.4, "hot", RNG.choice(list("abcd"), n)),
            "ts": [at(h) for h in RNG.integers(0, 24 * 8, n)],
        }
    )
    got = E.dedupe_dispatch(spark.createDataFrame(df)).select("id").toPandas()["id"]
    assert sorted(got) == greedy_dispatch(df, timedelta(hours=24))


def test_dispatch_ttl_runs_from_the_last_accepted(spark):
    rows = [(i, "k", at(h)) for i, h in enumerate([0, 20, 24, 47, 48.5, 200])]
    df = spark.createDataFrame(rows, "id long, idempotency_key string, ts timestamp")
    assert sorted(r["id"] for r in E.dedupe_dispatch(df).collect()) == [0, 2, 4, 5]


def greedy_intake(events, existing):
    seen_e, seen_r = {e for e, _ in existing}, {r for _, r in existing}
    out = []
    for t, e, r in sorted(events):
        if e not in seen_e and r not in seen_r:
            seen_e.add(e)
            seen_r.add(r)
            out.append((e, r))
    return sorted(out)


@pytest.mark.parametrize("ids", [8, 60])
def test_new_investigations_equal_one_by_one_intake(spark, ids):
    events = [(at(i // 3), f"e{a}", f"r{b}") for i, (a, b) in enumerate(zip(RNG.integers(0, ids, 150), RNG.integers(0, ids, 150)))]
    existing = [("e0", "r1"), ("e2", "r2")]
    ev = spark.createDataFrame(events, "created_at timestamp, event_id string, report_id string")
    ex = spark.createDataFrame([(f"i{i}", e, r, T0) for i, (e, r) in enumerate(existing)], "id string, drift_event_id string, drift_report_id string, created_at timestamp")
    got = sorted((r["event_id"], r["report_id"]) for r in E.open_investigations(ex, ev).collect())
    assert got == greedy_intake(events, existing)


def test_chain_of_three_events(spark):
    ev = spark.createDataFrame([(at(0), "a", "1"), (at(1), "a", "2"), (at(2), "b", "2")], "created_at timestamp, event_id string, report_id string")
    ex = spark.createDataFrame([], "id string, drift_event_id string, drift_report_id string, created_at timestamp")
    assert sorted(r["event_id"] for r in E.open_investigations(ex, ev).collect()) == ["a", "b"]


def test_repeated_alert_returns_the_earliest_investigation(spark):
    ex = spark.createDataFrame([("late", "e", "x", at(2)), ("early", "y", "r", at(1))], "id string, drift_event_id string, drift_report_id string, created_at timestamp")
    ev = spark.createDataFrame([("e", "r"), ("new", "new")], "event_id string, report_id string")
    assert [r["investigation_id"] for r in E.matched_investigations(ex, ev).collect()] == ["early"]
    ev = ev.withColumn("created_at", F.lit(at(5)))
    assert [r["event_id"] for r in E.open_investigations(ex, ev).collect()] == ["new"]


@pytest.mark.parametrize("severity,action,needs", [("low", "no_action", False), ("medium", "replay_test", True), ("high", "retrain", True)])
def test_proposals(spark, severity, action, needs):
    df = spark.createDataFrame([(severity, ["a", "b"])], "severity string, drifted_features array<string>")
    row = E.propose_action(df).first()
    assert (row["action"], row["requires_hil"], row["should_act"], row["priority"]) == (action, needs, needs, severity)
    if needs:
        assert row["rationale"] == f"Severity={severity}. Features drifted: ['a', 'b']."


@pytest.mark.parametrize("value", [0.0, 5.0, 0.41, 22.1, 1234567.0, 0.00001234, 123456.7, 0.1 + 0.2, 1e-4, 999999.5, 100000.0])
def test_number_text_has_six_significant_digits(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(E.significant(F.col("v"))).first()[0] == f"{value:g}"


def test_summary_and_field_extraction(spark):
    schema = "severity string, previous_severity string, model_name string, model_version int, report_id string, event_id string, top_features array<struct<feature:string,value:double,severity:string>>"
    rows = [("high", None, "m", 2, "r1", "e1", [("euribor3m", 0.41, "high"), ("job", 22.1, "high")]), ("low", "high", "m", 2, "r2", "e2", [])]
    first, second = E.alert_summary(spark.createDataFrame(rows, schema)).select(
        "summary", E.extract_field(F.col("summary"), "report_id").alias("r"), E.extract_field(F.col("summary"), "missing").alias("m")
    ).collect()
    assert "top_features=euribor3m=0.41 (high), job=22.1 (high). Drift severity changed from none to high for m v2." in first["summary"]
    assert "top_features=none. " in second["summary"] and (second["r"], second["m"]) == ("r2", "Not available")


def test_approval_staleness_and_dispatch(spark):
    proposals = spark.createDataFrame(
        [("a1", "i1", "retrain", 1, True, "r1", "high", "m"), ("a2", "i2", "retrain", 1, True, "r1", "high", "m"), ("a3", "i3", "retrain", 1, True, "old", "low", "m"),
         ("a4", "i4", "no_action", 1, False, "r1", "low", "m"), ("a5", "i5", "retrain", 9, True, "r1", "high", "gone")],
        "hil_approval_id string, investigation_id string, action string, model_version int, requires_hil boolean, drift_report_id string, severity string, model_name string",
    )
    approvals = spark.createDataFrame(
        [("a1", "i1", "retrain", 1, "approved", "approved"), ("a2", "other", "retrain", 1, "approved", "approved"), ("a3", "i3", "retrain", 1, "approved", "approved"), ("a5", "i5", "retrain", 9, "approved", "approved")],
        "id string, investigation_id string, action string, model_version int, status string, decision string",
    )
    reports = spark.createDataFrame([("m", "r0", at(0), "low"), ("m", "r1", at(1), "high")], "model_name string, report_id string, ts timestamp, severity string")
    versions = spark.createDataFrame([("m", 1, "Staging")], "model string, version int, stage string")
    plan = {r["hil_approval_id"]: r for r in E.dispatch_plan(proposals, approvals, reports, versions, ["model_name"]).collect()}
    assert {k: (r["dispatch_status"], r["reason"]) for k, r in plan.items()} == {
        "a1": ("enqueued", None), "a2": ("blocked", "approval_invalid"), "a3": ("blocked", "stale"), "a4": ("skipped", "no_action"), "a5": ("blocked", "unreconciled"),
    }


def test_new_report_with_the_same_severity_is_not_stale(spark):
    inv = spark.createDataFrame([("m", "old", "high")], "model_name string, drift_report_id string, severity string")
    rep = spark.createDataFrame([("m", "new", at(1), "high")], "model_name string, report_id string, ts timestamp, severity string")
    assert not E.stale_investigations(inv, rep, ["model_name"]).first()["stale"]


def test_upsert_keeps_the_latest_row(spark):
    state = spark.createDataFrame([("a", "low", 1), ("b", "high", 1)], "key string, severity string, seq int")
    new = spark.createDataFrame([("a", "medium", 3), ("a", "high", 2), ("c", "low", 1)], "key string, severity string, seq int")
    got = {r["key"]: r["severity"] for r in upsert_latest(state, new, ["key"], ["seq"]).collect()}
    assert got == {"a": "medium", "b": "high", "c": "low"}


def versions(spark, *rows):
    return spark.createDataFrame([(m, v, s, "run", t) for m, v, s, t in rows], "model string, version int, stage string, run_id string, tags map<string,string>")


REQUEST = "model_name string, target_version int, investigation_id string, hil_approval_id string"


@pytest.mark.parametrize(
    "staging,production,approval,reason",
    [
        ({"auc": "0.85", "recall": "0.60"}, {"auc": "0.83"}, "a", "recall_below_minimum"),
        ({"auc": "0.80", "recall": "0.80"}, {"auc": "0.85"}, "a", "auc_below_production"),
        ({"auc": "0.85", "recall": "0.80"}, {"auc": "0.85"}, "", "approval_missing"),
        ({"auc": "0.85", "recall": "0.80"}, {"auc": "0.85"}, "a", None),
        ({"recall": "0.80"}, None, "a", None),
        ({"auc": "", "recall": ""}, None, "a", "recall_below_minimum"),
    ],
)
def test_gates(spark, staging, production, approval, reason):
    have = [("m", 2, "Staging", staging)] + ([("m", 1, "Production", production)] if production else [])
    row = R.promotion_gates(spark.createDataFrame([("m", 2, "i", approval)], REQUEST), versions(spark, *have)).first()
    assert row["reason"] == reason and row["promoted"] == (reason is None)


def test_gates_need_a_staging_target_and_can_enforce_newer_drift(spark):
    have = versions(spark, ("m", 1, "Archived", {}), ("m", 2, "Staging", {"recall": "0.9"}))
    requests = spark.createDataFrame([("m", 1, "i", "a"), ("m", 7, "i", "a"), ("m", 2, "i", "a")], REQUEST)
    newer = spark.createDataFrame([("i",)], "investigation_id string")
    rows = R.promotion_gates(requests, have, newer_drift=newer, enforced=(True,) * 5).collect()
    assert {r["target_version"]: r["reason"] for r in rows} == {1: "not_staging", 7: "not_found", 2: "newer_drift"}


def test_promotion_moves_stages(spark):
    have = versions(spark, ("m", 1, "Production", {}), ("m", 2, "Staging", {}), ("n", 1, "Production", {}))
    done = spark.createDataFrame([("m", 2)], "model_name string, promoted_version int")
    assert {(r["model"], r["version"]): r["stage"] for r in R.apply_promotion(have, done).collect()} == {
        ("m", 1): "Archived", ("m", 2): "Production", ("n", 1): "Production",
    }


def test_versions_compare_as_integers(spark):
    have = versions(spark, ("m", 9, "Staging", {}), ("m", 10, "Staging", {"operating_threshold": "0.385"}), ("m", 3, "Archived", {}))
    assert R.latest_version_per_stage(have).where("stage = 'Staging'").first()["version"] == 10
    row = R.serving_version(have).first()
    assert (row["version"], row["stage"], row["threshold"]) == (10, "Staging", 0.385)


def test_intake_of_a_long_chain_needs_few_rounds(spark, monkeypatch):
    n = 5000
    events = spark.range(n).select(
        F.format_string("e%05d", F.floor(F.col("id") / 2)).alias("event_id"),
        F.format_string("r%05d", F.floor((F.col("id") + 1) / 2)).alias("report_id"),
        F.timestamp_seconds(F.col("id")).alias("created_at"),
    )
    none = spark.createDataFrame([], "drift_event_id string, drift_report_id string")
    rounds, cut = [], E.cut
    monkeypatch.setattr(E, "cut", lambda df: rounds.append(1) or cut(df))
    got = E.open_investigations(none, events)
    assert sorted(r.event_id for r in got.collect()) == [f"e{k:05d}" for k in range(n // 2)]
    assert len(rounds) < 10


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_long_chains_are_taken_in_slices(spark, monkeypatch, size):
    """One group has most events and hangs together in chains; no task gets more than about a slice of it."""
    monkeypatch.setattr(E, "SLICE_EVENTS", size)
    monkeypatch.setattr(E, "MIN_PROGRESS", 1.0)
    groups, take = [], E._take_slice
    monkeypatch.setattr(E, "_take_slice", lambda rows: groups.append(rows.count()) or take(rows))
    events = [(at(i), f"e{i // 2}", f"r{(i + 1) // 2}") for i in range(120)]
    events += [(at(int(t)), f"e{a}", f"r{b}") for t, a, b in zip(RNG.integers(0, 120, 80), RNG.integers(0, 90, 80), RNG.integers(0, 90, 80))]
    ev = spark.createDataFrame(events, "created_at timestamp, event_id string, report_id string")
    ex = spark.createDataFrame([("i", "e3", "r9", T0)], "id string, drift_event_id string, drift_report_id string, created_at timestamp")
    got = sorted((r["event_id"], r["report_id"]) for r in E.open_investigations(ex, ev).collect())
    assert got == greedy_intake(events, [("e3", "r9")])
    assert max(groups) <= 3 * size and (size == 1000) == (len(groups) == 1)


def test_null_ids_never_match(spark):
    t = "2024-01-01 00:00:0"
    rows = [("a", None, t + "1"), ("a", None, t + "2"), (None, "r", t + "3"), (None, "r", t + "4"), (None, None, t + "5"), (None, None, t + "5"), ("a", "q", t + "6"), ("b", None, t + "7")]
    events = spark.createDataFrame(rows, "event_id string, report_id string, created_at string")
    known = spark.createDataFrame([(None, "x"), ("c", None)], "drift_event_id string, drift_report_id string")
    got = sorted((r.event_id or "", r.report_id or "", r.created_at[-1]) for r in E.open_investigations(known, events).collect())
    assert got == [("", "", "5"), ("", "", "5"), ("", "r", "3"), ("a", "", "1"), ("b", "", "7")]


def test_dispatch_dedup_jobs_do_not_follow_the_time_span(spark):
    """Ten years of one dispatch a week: no run is unbroken, so no round is needed."""
    rows = spark.range(520).select(F.lit("k").alias("idempotency_key"), "id", F.timestamp_seconds(F.col("id") * 7 * 86_400).alias("ts"))
    assert E.dedupe_dispatch(rows).count() == 520
    daily = spark.range(4000).select(F.lit("k").alias("idempotency_key"), "id", F.timestamp_seconds(F.col("id") * 50_000).alias("ts"))
    assert [r.id for r in E.dedupe_dispatch(daily).orderBy("id").collect()] == list(range(0, 4000, 2))
