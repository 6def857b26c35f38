from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tideline.operators import decisions as E
from tideline.operators import drift as D
from tideline.operators import profile as P
from tideline.operators import validate as V
from tideline.session import session_options
from tideline.sources.prediction_log import rolling_window
from tideline.sources.versioned import keyed_table, read_version
from tideline.streaming import jobs as J
from tideline.streaming import state as S

T0 = datetime(2024, 1, 1)
RNG = np.random.default_rng(2)


def source(spark, df, path, files):
    """A file stream that delivers ``df`` in ``files`` micro-batches of one file."""
    for i in range(files):
        df.where(F.pmod("seq", F.lit(files)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.fixture(scope="module")
def log(spark):
    n = 600
    rows = pd.DataFrame(
        {
            "seq": np.arange(n), "id": [f"{i:05d}" for i in range(n)], "k": RNG.choice(["hot", "hot", "b"], n), "x": RNG.normal(size=n) + np.arange(n) / 200,
            "c": RNG.choice(["u", "v"], n), "label": RNG.integers(0, 2, n), "created_at": [T0 + timedelta(minutes=int(m)) for m in RNG.integers(0, 10_000, n)],
        }
    )
    return spark.createDataFrame(rows)


def test_stream_report_equals_batch_report_and_survives_restart(spark, log, tmp_path):
    ref = log.where("seq < 200")
    profile = P.reference_profile(ref, ["x"], ["c"], F.col("label"))
    stream = source(spark, log, str(tmp_path / "in"), 3)
    reports = str(tmp_path / "r")
    run = lambda: finish(
        J.drift_stream(stream, profile, ["x"], ["c"], F.col("label"), reports, str(tmp_path / "cp"), n=50, keys=["k"], trigger={"availableNow": True})
    )
    run()
    late = log.where("seq < 30").withColumn("id", F.concat(F.lit("late"), "id"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # same checkpoint: only the new file is read
    last = spark.read.parquet(reports).agg(F.max("batch_id")).first()[0]
    assert last == 3
    got = D.exploded_report(spark.read.parquet(f"{reports}/batch_id={last}"), ["k"]).drop("report_id").collect()
    want = D.exploded_report(D.drift_report(profile, rolling_window(log.unionByName(late), 50, keys=["k"]), ["x"], ["c"], F.col("label"), ["k"]), ["k"]).drop("report_id").collect()
    assert sorted(got) == sorted(want) and len(got) == 6


def test_scoring_splits_valid_and_rejected_rows(spark, log, tmp_path):
    stream = source(spark, log, str(tmp_path / "in"), 2)
    rules = [V.in_range("x", -1.0, 3.0)]
    score = lambda df: df.withColumn("probability", F.lit(0.9))
    finish(J.score_stream(stream, score, rules, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "cp")))
    good, bad = spark.read.parquet(str(tmp_path / "log")), spark.read.parquet(str(tmp_path / "bad"))
    assert good.count() == log.where("x between -1 and 3").count() and good.count() + bad.count() == 600
    assert bad.select(F.explode("violations")).distinct().first()[0] == "x:range"


@pytest.fixture(scope="module")
def reports(spark):
    n = 300
    rows = pd.DataFrame(
        {
            "seq": np.arange(n), "key": RNG.choice(["m:1", "m:1", "m:2"], n), "report_id": [f"r{i:04d}" for i in range(n)],
            "severity": RNG.choice(["low", "medium", "high"], n), "ts": [T0 + timedelta(hours=int(i)) for i in range(n)],
        }
    )
    return spark.createDataFrame(rows)


def ordered_files(spark, df, path, files):
    """Micro-batches in time order."""
    size = df.count() // files + 1
    for i in range(files):
        df.where((F.col("seq") >= i * size) & (F.col("seq") < (i + 1) * size)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("files", [1, 4])
def test_change_events_equal_batch_changes(spark, reports, tmp_path, files):
    want = {(r["key"], r["report_id"], r["previous_severity"]) for r in E.severity_changes(reports, ["key"]).collect()}
    stream = ordered_files(spark, reports, str(tmp_path / "in"), files)
    deliver = lambda df, batch_id: J.write_batch(df, str(tmp_path / "out"), batch_id)
    finish(J.severity_change_stream(stream, deliver, str(tmp_path / "state"), str(tmp_path / "cp")))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["key"], r["report_id"], r["previous_severity"]) for r in out.collect()} == want
    assert out.select("event_id").distinct().count() == len(want)

    query = S.severity_change_events(ordered_files(spark, reports, str(tmp_path / "in2"), files)).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp2")
    ).trigger(availableNow=True).start(str(tmp_path / "out2"))
    finish(query)
    got = spark.read.parquet(str(tmp_path / "out2")).collect()
    assert {(r["key"], r["report_id"], r["previous_severity"]) for r in got} == want


def test_failed_delivery_leaves_the_state(spark, reports, tmp_path):
    stream = ordered_files(spark, reports, str(tmp_path / "in"), 2)
    calls = []

    def deliver(df, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise ConnectionError("sink is down")
        J.write_batch(df, str(tmp_path / "out"), batch_id)

    start = lambda: J.severity_change_stream(stream, deliver, str(tmp_path / "state"), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="sink is down"):
        start().awaitTermination(120)
    assert not (tmp_path / "state").exists()
    finish(start())
    want = E.severity_changes(reports, ["key"]).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want and calls == [0, 0, 1]


@pytest.mark.parametrize("files", [1, 5])
def test_stream_dedup_equals_batch_dedup(spark, tmp_path, files):
    rows = pd.DataFrame({"seq": np.arange(200), "idempotency_key": RNG.choice(list("abc"), 200)})
    rows["id"] = [f"{i:04d}" for i in rows["seq"]]
    rows["ts"] = [T0 + timedelta(minutes=int(m)) for m in np.sort(RNG.integers(0, 8000, 200))]
    df = spark.createDataFrame(rows)
    stream = ordered_files(spark, df, str(tmp_path / "in"), files)
    query = S.dedupe_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    finish(query)
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["id"] for r in E.dedupe_dispatch(df).collect())


def run_to_end(stream, out, cp):
    query = stream.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
    finish(query)
    return query


def test_hot_key_in_many_frames_equals_batch_dedup(spark, tmp_path):
    """Frames of seven rows: all but the first wait in state, slice by slice, and none stays there."""
    n = 400
    rows = pd.DataFrame({"idempotency_key": ["hot"] * n, "id": [f"{i:04d}" for i in RNG.permutation(n)], "ts": [T0 + timedelta(minutes=int(m)) for m in RNG.integers(0, 12_000, n)]})
    df = spark.createDataFrame(rows)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    with session_options(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "7"}):
        query = run_to_end(S.dedupe_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["id"] for r in E.dedupe_dispatch(df).collect()) and len(got) > 4
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress) >= n / 7


def test_state_leaves_a_ttl_behind_the_watermark(spark, tmp_path):
    kind, path, out = "idempotency_key string, id string, ts timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    sizes, rows = [], []

    def feed(*new):
        new = [(k, i, T0 + timedelta(hours=h) if h is not None else None) for k, i, h in new]
        rows.extend(new)
        spark.createDataFrame(new, kind).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kind).parquet(path)
        query = run_to_end(S.dedupe_stream(stream, lateness="1 hour"), out, str(tmp_path / "cp"))
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    feed(*[(f"k{i}", f"a{i}", 0) for i in range(20)], ("k0", "a-", 1), ("k9", "no time", None))
    feed(("k1", "b", 25), ("k2", "b", 20))
    feed(("k1", "c", 100))
    feed(("k2", "d", 101), ("k3", "d", 102))
    keyed = [r for r in rows if r[0]]
    want = {(r["idempotency_key"], r["id"]) for r in E.dedupe_dispatch(spark.createDataFrame(keyed, kind)).collect()}
    assert {(r["idempotency_key"], r["id"]) for r in spark.read.parquet(out).collect()} == want
    assert {("k1", "b"), ("k1", "c"), ("k2", "d")} <= want and ("k2", "b") not in want
    assert sizes[0] > sizes[-1], sizes  # the keys of the first day are gone, those of the last day are there


def test_a_key_of_few_rows_takes_rows_and_few_state_calls(monkeypatch):
    """No data frame is made for it; the state is asked once and written once."""
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a)) or (State() if name.startswith("get") and a else None)

    dedup = S.LastAccepted(10)
    dedup.init(State())
    calls.clear()
    monkeypatch.setattr(S.pd, "DataFrame", None)
    rows = [Row(idempotency_key="k", id=i, at=None, t=t) for t, i in [(25, "d"), (5, None), (5, "b"), (14, "c"), (15, None), (15, None), (24, "e")]]
    assert [tuple(r) for r in dedup.handleInputRows(("k",), iter(rows), None)] == [("k", "b", 5), ("k", None, 15), ("k", "d", 25)]
    assert calls == [("get",), ("update", (25,)), ("registerTimer", 1)]


def test_ring_writes_only_what_changes(spark, tmp_path):
    kind, path = "k string, v bigint, w double, at timestamp, label int", str(tmp_path / "in")
    seen, n = [], 5

    def feed(*new):
        spark.createDataFrame([(k, v, w, T0 + timedelta(seconds=s) if s is not None else None, None) for k, v, w, s in new], kind).coalesce(1).write.mode("append").parquet(path)
        windows = S.newest_rows(spark.readStream.schema(kind).parquet(path), n, ["at", "v"], ["k"])
        got = []
        query = windows.writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        finish(query)
        assert windows.schema.simpleString() == spark.createDataFrame([], kind).schema.simpleString()
        seen.extend(tuple(r) for r in spark.createDataFrame([(k, v, w, T0 + timedelta(seconds=s) if s is not None else None, None) for k, v, w, s in new], kind).collect())
        changed = {k for k, *_ in new}
        for key in changed:
            mine = sorted((r for r in seen if r[0] == key), key=lambda r: (r[3] is not None, r[3], r[1]))[-n:]
            assert sorted([tuple(r) for r in got if r["k"] == key], key=str) == sorted(mine, key=str)
        assert {r["k"] for r in got} == changed
        return query.lastProgress["stateOperators"][0]

    big = 2**60 + 1
    feed(*[(f"k{i % 3}", big + i, 0.1 * i, i) for i in range(60)], ("k0", 1, None, None), (None, 5, 1e-7, 5))
    one = feed(("k0", 7, float("inf"), 1000))
    assert one["numRowsUpdated"] <= 3 and one["numRowsTotal"] >= 3 * n
    late = feed(("k1", 8, 0.5, -50))
    assert late["numRowsUpdated"] == 0


def test_rows_of_a_hot_key_are_thinned_out_over_all_frames(monkeypatch):
    """What a task passes on does not grow with its rows; many keys are passed on within the bound."""
    monkeypatch.setattr(S, "TRIM_ROWS", 40)
    place = RNG.permutation(1000)
    rows = pd.DataFrame({"key": "hot", "rank": [f'{{"o0":{v}}}' for v in place], "row": [str(v) for v in place]})
    frames = lambda df: iter([df.iloc[i : i + 10] for i in range(0, len(df), 10)])
    out = pd.concat(list(S._trim(5)(frames(rows))))
    assert sorted(map(int, out["row"])) == list(range(995, 1000))
    many = rows.assign(key=[str(v % 300) for v in place])
    parts = list(S._trim(5)(frames(many)))
    assert max(map(len, parts)) <= 50 and pd.concat(parts)["row"].nunique() == sum(map(len, parts)) == 1000


def test_dead_letters_after_three_attempts(spark, tmp_path):
    calls = []

    def fails(df, name):
        calls.append(name)
        if df.where("v < 0").count():
            raise ValueError("negative")

    run = J.with_dead_letter(fails, str(tmp_path / "dead"), "retrain", waits=())
    run(spark.createDataFrame([(1,)], "v int"), 0)
    run(spark.createDataFrame([(-1,)], "v int"), 1)
    assert calls == [0, 1, 1, 1]
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert [(r["job_type"], r["payload"], r["error"], r["isolated"]) for r in dead] == [("retrain", '{"v":-1}', "negative", True)]


def test_one_bad_record_in_very_many_is_found(spark, tmp_path):
    sink, dead, calls = str(tmp_path / "sink"), str(tmp_path / "dead"), []

    def job(df, name):
        calls.append(name)
        J.write_batch(df.where("v <> 77777"), sink, name)  # half-written: the failure comes after the write
        if df.where("v = 77777").count():
            raise ValueError("bad record")

    rows = spark.range(100_000).select(F.col("id").alias("v"))
    for _ in range(2):  # the batch is repeated after a restart
        J.with_dead_letter(job, dead, "job", attempts=2, waits=(), sinks=[sink])(rows, 4)
    letters = spark.read.parquet(dead).collect()
    assert [(r["payload"], r["isolated"]) for r in letters] == [('{"v":77777}', True)]
    done = spark.read.option("recursiveFileLookup", "true").parquet(sink)
    assert done.count() == done.distinct().count() == 99_999 and len(calls) < 100


def test_what_is_not_isolated_in_time_is_kept_unsplit(spark, tmp_path):
    def job(df, name):
        raise ValueError("down")

    rows = spark.createDataFrame([(i,) for i in range(40)] + [(1,)] * 3, "v int")
    J.with_dead_letter(job, str(tmp_path / "dead"), "job", attempts=1, waits=(), runs=6)(rows, 0)
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert sorted(r["payload"] for r in dead.collect()) == sorted(f'{{"v":{r["v"]}}}' for r in rows.collect())
    assert not all(r["isolated"] for r in dead.collect())
    J.with_dead_letter(job, str(tmp_path / "all"), "job", attempts=1, waits=())(rows, 0)
    every = spark.read.parquet(str(tmp_path / "all")).collect()
    assert len(every) == 43 and 0 < sum(r["isolated"] for r in every) < 43  # it fails for every part, so it is given up


def test_late_reports_are_compared_with_what_was_delivered(spark, tmp_path):
    """A report older than the stored state does not go out again with the same severity."""
    path, state, seen = str(tmp_path / "in"), str(tmp_path / "s"), []
    kind = "key string, report_id string, severity string, ts timestamp"

    def feed(*rows):
        spark.createDataFrame([(k, r, s, T0 + timedelta(days=d)) for k, r, s, d in rows], kind).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(kind).parquet(path)
        deliver = lambda df, n: seen.extend((r.key, r.report_id, r.previous_severity) for r in df.collect())
        finish(J.severity_change_stream(stream, deliver, state, str(tmp_path / "cp")))

    feed(("a", "r1", "low", 8), ("a", "r2", "high", 10))
    feed(("a", "r3", "high", 5))
    feed(("a", "r4", "low", 6), ("b", "r5", "low", 1))
    feed(("a", "r6", "low", 11))
    assert sorted(seen) == [("a", "r1", None), ("a", "r2", "low"), ("a", "r4", "high"), ("b", "r5", None)]


def test_state_of_severities_moves_by_bucket(spark, tmp_path):
    """A batch rewrites the buckets of its keys; a batch that comes again after its state was published changes nothing."""
    path, state, mark, seen = str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "cp"), []
    kind = "key string, report_id string, severity string, ts timestamp"

    def feed(*rows):
        spark.createDataFrame([(k, r, s, T0 + timedelta(days=d)) for k, r, s, d in rows], kind).coalesce(1).write.mode("append").parquet(path)
        run()

    def run():
        stream = spark.readStream.schema(kind).parquet(path)
        deliver = lambda df, n: seen.append((n, sorted([(r.key, r.severity, r.previous_severity) for r in df.collect()], key=str)))
        finish(J.severity_change_stream(stream, deliver, state, mark, buckets=64))

    feed(*[(f"k{i}", f"r{i}", "low", 1) for i in range(200)], (None, "rn", "high", 1))
    first = read_version(spark, state)
    feed(("k3", "x", "high", 5), (None, "rm", "low", 4))
    second = read_version(spark, state)
    assert second.info["rewritten"] <= 2 < first.info["rewritten"] and second.number == 1
    assert seen[1] == (1, sorted([("k3", "high", "low"), (None, "low", "high")], key=str))
    # The stream's own commit of the batch is lost, so the batch comes again.
    for f in (tmp_path / "cp" / "commits").iterdir():
        if f.name.strip(".").removesuffix(".crc") == "1":
            f.unlink()
    run()
    assert seen[2] == seen[1] and read_version(spark, state).number == 1
    now = {r.key: (r.report_id, r.severity) for r in keyed_table(read_version(spark, state)).collect()}
    assert len(now) == 201 and now["k3"] == ("x", "high") and now["k4"] == ("r4", "low") and now[None] == ("rm", "low")
    feed(("k3", "y", "low", 2))  # late, but delivered last
    assert seen[3] == (2, [("k3", "low", "high")])
    assert {r.key: r.report_id for r in keyed_table(read_version(spark, state)).collect()}["k3"] == "y"


def test_old_states_leave(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "EXPIRE_EVERY", 3)
    monkeypatch.setattr(J, "KEEP", 1)
    kind = "key string, report_id string, severity string, ts timestamp"
    for i in range(3):
        spark.createDataFrame([("a", f"r{i}", "low", T0 + timedelta(days=i))], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        finish(J.severity_change_stream(stream, lambda df, n: df.count(), str(tmp_path / "s"), str(tmp_path / "cp"), buckets=4))
    assert len(list((tmp_path / "s" / "data").iterdir())) == 1
    assert [r.report_id for r in keyed_table(read_version(spark, str(tmp_path / "s"))).collect()] == ["r2"]


def test_a_broken_state_is_no_fresh_start(spark, tmp_path):
    manifests = tmp_path / "_manifests"
    manifests.mkdir()
    (manifests / "000000000.json").write_text("{not json")
    with pytest.raises(ValueError):
        J._state_before(spark, str(tmp_path), "mark", 1)
    assert J._state_before(spark, str(tmp_path / "none"), "mark", 3)[0].number == -1
