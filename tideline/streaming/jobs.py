"""Continuous forms: scoring with quarantine, drift over a count window, change events, dispatch dedup.

Sinks are written per micro-batch under ``batch_id=<n>`` with overwrite, so a repeated batch replaces
itself. Order is the time that a row carries; late rows are ranked by it. State that streams keep per key is
in ``state.py``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tideline.operators.decisions import event_id, severity_changes
from tideline.operators.drift import drift_report
from tideline.operators.profile import ReferenceProfile
from tideline.operators.validate import Rule, validate
from tideline.session import cut
from tideline.sources.prediction_log import WINDOW
from tideline.sources.tables import upsert_latest
from tideline.sources.versioned import BUCKETS, Version, expire, read_version, rows_beside, upsert
from tideline.streaming.state import newest_rows

REPORT_INTERVAL = "60 seconds"
#: Old versions of a stream's state go every so many versions; so many stay for those who read.
EXPIRE_EVERY = 16
KEEP = 4

BatchFn = Callable[[DataFrame, int], None]


def write_batch(df: DataFrame, path: str, batch_id: int | str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _start(stream: DataFrame, fn: BatchFn, checkpoint: str, trigger: dict | None, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _drop(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def with_dead_letter(
    fn: Callable[[DataFrame, int | str], None], path: str, job_type: str, attempts: int = 3, waits: Sequence[float] = (1.0, 2.0),
    sinks: Sequence[str] = (), runs: int = 400,
) -> BatchFn:
    """Run ``fn`` up to ``attempts`` times per batch; then find the records it fails for and store those instead.

    A batch that still fails is fixed in the shared folder and halved by the hash of its row numbers, again and
    again: a half that passes is done, a single row that fails is a dead letter. So one bad record costs about
    twice the logarithm of the batch in runs of ``fn``, and all others are handled once. After ``runs`` runs, or
    where none of the first parts down to single rows has passed (a job that fails whatever it gets), what has
    not passed is stored unsplit (``isolated`` false); nothing is lost.

    ``fn`` gets the rows and a name for them: the batch's number, or ``<number>.<bits>`` for a part. What it writes
    has to go by that name (:func:`write_batch`) into the folders ``sinks``: what a failed run left there is
    removed, and a repeated batch starts anew. Dead letters are ``job_type, payload`` (the row as
    JSON), ``error, isolated``.
    """

    def attempt(df: DataFrame, name: int | str) -> str | None:
        try:
            fn(df, name)
        except Exception as error:
            for sink in sinks:
                _drop(df.sparkSession, f"{sink}/batch_id={name}")
            return str(error)
        return None

    def run(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        for sink in sinks:  # parts of an earlier run of this batch
            _drop_matching(spark, f"{sink}/batch_id={batch_id}.*")
        for k in range(attempts):
            error = attempt(df, batch_id)
            if error is None:
                return
            if waits and k + 1 < attempts:
                time.sleep(waits[min(k, len(waits) - 1)])
        number = "__row"
        rows = cut(df.withColumn(number, F.monotonically_increasing_id()))
        at = F.shiftrightunsigned(F.xxhash64(number), 1)
        letters, left, passed = [], runs, False
        hopeless = runs - 4 * rows.count().bit_length() - 16
        # (bits, how many bits, error): parts that have failed
        failed = [(0, 0, error)]
        while failed:
            bits, depth, error = failed.pop()
            part = rows.where(F.shiftright(at, 63 - depth) == bits) if depth else rows
            single = part.limit(2).count() < 2
            if single or depth == 62 or left < 2 or (left <= hopeless and not passed):
                letters.append((part, error, single))
                continue
            for half in (2 * bits, 2 * bits + 1):
                rest = rows.where(F.shiftright(at, 62 - depth) == half)
                if rest.isEmpty():
                    continue
                left -= 1
                wrong = attempt(rest.drop(number), f"{batch_id}.{half:0{depth + 1}b}")
                passed = passed or wrong is None
                if wrong is not None:
                    failed.append((half, depth + 1, wrong))
        for k, (part, error, single) in enumerate(letters):
            found = part.drop(number)
            out = found.select(F.lit(job_type).alias("job_type"), F.to_json(F.struct(*df.columns)).alias("payload"), F.lit(error).alias("error"), F.lit(single).alias("isolated"))
            out.write.mode("overwrite" if k == 0 else "append").parquet(f"{path}/batch_id={batch_id}")

    return run


def _drop_matching(spark: SparkSession, pattern: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(pattern)
    for found in where.getFileSystem(conf).globStatus(where) or []:
        _drop(spark, found.getPath().toString())


def score_stream(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    rules: Sequence[Rule],
    log_path: str,
    quarantine_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Validate, score and log a stream; rejected rows go to quarantine with their violations.

    ``score`` maps valid rows to log rows.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        checked = df.persist()  # the batch is read once for both sinks
        try:
            valid, rejected = validate(checked, rules)
            write_batch(score(valid), log_path, batch_id)
            write_batch(rejected, quarantine_path, batch_id)
        finally:
            checked.unpersist()

    return _start(stream, batch, checkpoint, trigger)


def drift_stream(
    stream: DataFrame,
    profile: ReferenceProfile,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: Column,
    report_path: str,
    checkpoint: str,
    n: int = WINDOW,
    order_col: str = "created_at",
    tie: Sequence[str] = ("id",),
    keys: Sequence[str] = (),
    mode: str = "proportions",
    trigger: dict | None = None,
) -> StreamingQuery:
    """A drift report over the last ``n`` rows (per key) after every micro-batch, for the keys that it brought rows of.

    The windows are state of the stream: what is written per batch follows the rows that change, not the
    number of keys, and old windows are not kept. Needs the RocksDB state store.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        window = cut(df)  # state moves once per batch, however often the window is read
        ident = F.md5(F.concat_ws("|", *keys, F.lit(str(batch_id))))
        write_batch(drift_report(profile, window, numeric, categorical, label, keys, mode, report_id=ident), report_path, batch_id)

    windows = newest_rows(stream, n, [order_col, *tie], keys)
    return _start(windows, batch, checkpoint, trigger or {"processingTime": REPORT_INTERVAL}, "update")


def _state_before(spark: SparkSession, path: str, writer: str, batch_id: int) -> tuple[Version, bool]:
    """The state that a batch starts from, and whether the batch has published its own already."""
    newest = read_version(spark, path)
    if (newest.info.get("writer"), newest.info.get("batch")) != (writer, batch_id):
        return newest, False
    return (read_version(spark, path, newest.number - 1) if newest.number else Version(spark, path)), True


def severity_change_stream(
    reports: DataFrame,
    deliver: BatchFn,
    state_path: str,
    checkpoint: str,
    key: str = "key",
    ts: str = "ts",
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Emit a report whenever a key's severity differs from the last delivered one.

    The state comes first, then the batch in order of time: a late report is compared with what was
    delivered last, not with what was known at its time.

    ``reports`` has ``key, report_id, severity, ts``. State moves only after ``deliver`` returns: if
    delivery fails, the batch is repeated and finds the old state; so does a batch that stopped between its new
    state and the stream's own commit. Event ids are derived from key and report, so a repeat gives the same ids.

    The state is a versioned table in buckets by key (``keyed_table(read_version(spark, state_path))``): a batch reads
    and rewrites the buckets of its own keys only. A stream with a new checkpoint goes on from the state there is.
    Of old versions the newest few stay.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        fields = [key, "report_id", "severity", ts]
        spark, rows = df.sparkSession, cut(df.select(*fields))
        state, repeated = _state_before(spark, state_path, checkpoint, batch_id)
        known = rows_beside(state, rows, [key]).select(*fields) if state.number >= 0 else rows.limit(0)
        first = F.lit("0001-01-01").cast(known.schema[ts].dataType)  # before any report
        marked = known.withColumns({"__old": F.lit(True), "__at": first}).unionByName(rows.withColumns({"__old": F.lit(False), "__at": F.col(ts)}))
        changes = severity_changes(marked, [key], "__at").where(~F.col("__old")).drop("__old", "__at")
        deliver(changes.withColumn("event_id", event_id(F.col(key).cast("string"), F.col("report_id"))), batch_id)
        if repeated:
            return
        # What a batch brings last replaces the state, however late it is: the version comes before the time.
        latest = upsert_latest(rows.limit(0), rows, [key], [ts, "report_id"]).withColumn("__version", F.lit(state.number + 1).cast("long"))
        now = upsert(spark, state_path, latest, [key], ["__version", ts, "report_id"], buckets, {"writer": checkpoint, "batch": batch_id})
        if now.number % EXPIRE_EVERY == EXPIRE_EVERY - 1:
            expire(spark, state_path, KEEP)

    return _start(reports, batch, checkpoint, trigger)
