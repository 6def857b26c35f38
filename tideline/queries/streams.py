"""Streaming jobs as queries: a file stream over given tables, run to its end, with SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import decisions as E
from tideline.operators import drift as D
from tideline.operators import profile as P
from tideline.operators import validate as V
from tideline.queries import core, tables
from tideline.queries.views import CATEGORICAL, NUMERIC, current, reference, table
from tideline.session import scratch_path, session_options
from tideline.sources import tables as S
from tideline.sources.versioned import keyed_table, read_version
from tideline.streaming import jobs as J
from tideline.streaming.state import ROCKSDB, dedupe_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _stream(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A stream over the rows of ``df``, and the folder that more rows can be added to."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path), path


def _finish(started) -> None:
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


@query(tables.ORACLES["dispatch_dedup"])
def stream_dispatch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Dispatches come in two runs, split at a point in time; expired state leaves between them."""
    rows = table(spark, sf, "events").select(
        E.idempotency_key(F.col("event_type"), F.col("user_id")).alias("idempotency_key"), F.col("event_id").alias("id"), "ts"
    )
    split = rows.agg(F.timestamp_micros(((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2).cast("bigint")).alias("t")).first()["t"]
    stream, path = _stream(rows.where(F.col("ts") < F.lit(split)), "dispatches")
    out, mark = scratch_path(spark, "accepted"), scratch_path(spark, "mark")
    with session_options(spark, {PROVIDER: ROCKSDB}):
        for more in (None, rows.where(F.col("ts") >= F.lit(split))):
            if more is not None:
                more.write.mode("append").parquet(path)
            accepted = dedupe_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
            _finish(accepted.outputMode("append").trigger(availableNow=True).start())
    kept = spark.read.schema("idempotency_key string, id string, t long").parquet(out)
    kind = dict(rows.dtypes)
    return kept.select("idempotency_key", F.col("id").cast(kind["id"]).alias("id"), F.timestamp_micros("t").cast(kind["ts"]).alias("ts"))


# Every seventh order comes late: its report arrives after all others, whatever its date.
_LATE = f"""{tables.REPORTS}, arrived AS (SELECT *, CASE WHEN CAST(substr(report_id, 2) AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS batch FROM reports)"""


def _severity_run(spark: SparkSession, sf: str) -> tuple[str, str]:
    rows = tables.reports(spark, sf).withColumnRenamed("model", "key")
    late = F.substring("report_id", 2, 30).cast("long") % 7 == 0
    stream, path = _stream(rows.where(~late), "reports")
    sent, state, mark = (scratch_path(spark, x) for x in ("sent", "state", "mark"))
    run = lambda: _finish(J.severity_change_stream(stream, lambda df, n: J.write_batch(df, sent, n), state, mark))
    run()
    rows.where(late).write.mode("append").parquet(path)
    run()
    return sent, state


@query(f"""WITH {_LATE}, c AS (SELECT *, lag(severity) OVER (PARTITION BY model ORDER BY batch, ts, report_id) AS previous_severity FROM arrived)
SELECT model, report_id, ts, severity, previous_severity FROM c WHERE previous_severity IS DISTINCT FROM severity""")
def stream_severity_changes(spark: SparkSession, sf: str) -> DataFrame:
    sent, _ = _severity_run(spark, sf)
    return spark.read.parquet(sent).select(F.col("key").alias("model"), "report_id", "ts", "severity", "previous_severity")


@query(f"""WITH {_LATE}, c AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY batch DESC, ts DESC, report_id DESC) AS k FROM arrived)
SELECT model, report_id, ts, severity FROM c WHERE k = 1""")
def alert_state_after_delivery(spark: SparkSession, sf: str) -> DataFrame:
    _, state = _severity_run(spark, sf)
    return keyed_table(read_version(spark, state)).select(F.col("key").alias("model"), "report_id", "ts", "severity")


@query(f"""SELECT l_orderkey, l_linenumber, '' AS violations FROM ({core.ORACLES['validate_rows']})
UNION ALL SELECT l_orderkey, l_linenumber, violations FROM ({core.ORACLES['rejected_rows']})""")
def stream_scoring(spark: SparkSession, sf: str) -> DataFrame:
    stream, _ = _stream(core.bank(spark, sf), "bank")
    log, bad, mark = (scratch_path(spark, x) for x in ("log", "quarantine", "mark"))
    _finish(J.score_stream(stream, lambda df: df.select("l_orderkey", "l_linenumber"), V.serving_rules(), log, bad, mark))
    rejected = spark.read.parquet(bad).select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"))
    return spark.read.parquet(log).select("l_orderkey", "l_linenumber", F.lit("").alias("violations")).unionByName(rejected)


def _dead_letters(spark: SparkSession, sf: str, bad) -> tuple[str, str]:
    """Folders of what was done and of the dead letters, of a job that cannot take some records."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts")
    stream, _ = _stream(rows, "jobs")
    done, letters, mark = (scratch_path(spark, x) for x in ("done", "letters", "mark"))

    def job(df: DataFrame, name: int | str) -> None:
        if df.where(bad).limit(1).count():
            raise ValueError("no such job")
        J.write_batch(df.select("event_id"), done, name)

    _finish(J._start(stream, J.with_dead_letter(job, letters, "dispatch", attempts=2, waits=(), sinks=[done]), mark, None))
    return done, letters


@query("""SELECT 'dispatch' AS job_type, event_id, 'no such job' AS error FROM events""")
def stream_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """A job that always fails: all its rows end as dead letters, with the whole error."""
    _, letters = _dead_letters(spark, sf, F.lit(True))
    return spark.read.parquet(letters).select("job_type", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), "error")


@query("""WITH b AS (SELECT min(event_id) AS low, max(event_id) AS high FROM events)
SELECT event_id, CASE WHEN event_id IN (low, high) THEN 'dead letter, isolated' ELSE 'done' END AS outcome FROM events, b""")
def stream_bad_records(spark: SparkSession, sf: str) -> DataFrame:
    """A job fails for two records (the least and the greatest id): they alone end as dead letters, all others are done once."""
    ends = table(spark, sf, "events").agg(F.min("event_id"), F.max("event_id")).first()
    done, letters = _dead_letters(spark, sf, F.col("event_id").isin(*ends))
    kind = F.concat(F.lit("dead letter"), F.when(F.col("isolated"), ", isolated").otherwise(""))
    dead = spark.read.parquet(letters).select(F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), kind.alias("outcome"))
    names = spark.read.option("recursiveFileLookup", "true").schema("event_id bigint").parquet(done)
    return names.select("event_id", F.lit("done").alias("outcome")).unionByName(dead)


@query(core.ORACLES["psi_by_feature"])
def psi_from_saved_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The reference statistics go through storage and come back."""
    path = scratch_path(spark, "profile")
    S.save_profile(P.reference_profile(reference(spark, sf), NUMERIC, [], F.lit(None).cast("int")), path)
    return D.psi(S.load_profile(spark, path).numeric, current(spark, sf), NUMERIC).withColumn("psi", F.round("psi", 6))


# The last 5000 rows of the current window, after it has come in two runs.
_LAST = 5000
_LAST_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _windowed(sql: str) -> str:
    sql = sql.replace("cur AS (", "all_cur AS (", 1)
    at = sql.index(core._LONG_REF)
    order = ", ".join(f"{c} DESC" for c in ("l_orderkey", *_LAST_ORDER))
    return f"{sql[:at]}cur AS (SELECT * FROM all_cur ORDER BY {order} LIMIT {_LAST}), {sql[at:]}"


@query(_windowed(core.ORACLES["drift_report"]))
def stream_drift_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = current(spark, sf).select("l_orderkey", *_LAST_ORDER, *[c for c in (*NUMERIC, *CATEGORICAL) if c != "l_quantity"], "label")
    early = F.pmod(F.xxhash64("l_orderkey", "l_partkey"), F.lit(3)) < 2
    stream, path = _stream(rows.where(early), "scored")
    profile = P.reference_profile(reference(spark, sf), NUMERIC, CATEGORICAL, F.col("label"))
    out, mark = (scratch_path(spark, x) for x in ("report", "mark"))
    for more in (None, rows.where(~early)):
        if more is not None:
            more.write.mode("append").parquet(path)
        with session_options(spark, {PROVIDER: ROCKSDB}):
            _finish(J.drift_stream(stream, profile, NUMERIC, CATEGORICAL, F.col("label"), out, mark, _LAST, "l_orderkey", _LAST_ORDER, trigger={"availableNow": True}))
    return D.exploded_report(spark.read.parquet(f"{out}/batch_id=1")).drop("report_id").withColumn("value", F.round("value", 6))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 500""")
def first_rows_of_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of a delimited batch, all columns as text, in the order of that text."""
    path = scratch_path(spark, "batch")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.option("header", True).csv(path)
    return S.read_batch(spark, path, 500, ["o_orderkey"])


@query("""SELECT run, o_orderstatus AS model, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS score FROM orders, (VALUES ('first'), ('second')) r(run)
WHERE run = 'first' OR o_orderkey % 2 = 0 GROUP BY ALL""")
def run_metrics_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs append to one table of metrics."""
    path, orders = scratch_path(spark, "metrics"), table(spark, sf, "orders")
    for run, rows in (("first", orders), ("second", orders.where("o_orderkey % 2 = 0"))):
        metrics = rows.groupBy(F.col("o_orderstatus").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score"))
        S.append_run_metrics(metrics.select(F.lit(run).alias("run"), "*"), path)
    return spark.read.parquet(path)


@query(f"""WITH {core._ALL} SELECT feature, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, dof, {core._CHI_SEV} AS severity,
  CAST(floor(mass * current_n) AS BIGINT) AS reference_n, current_n FROM pv""")
def chi2_rows_in_full(spark: SparkSession, sf: str) -> DataFrame:
    return core._chi2(spark, sf).withColumns({c: F.round(c, 6) for c in ("statistic", "p_value")})
