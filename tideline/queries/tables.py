"""Queries for sampling, scenarios, decisions, registry and evaluation, with SQL to check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import decisions as E
from tideline.operators import evaluate as M
from tideline.operators import registry as R
from tideline.operators import sampling as L
from tideline.operators import scenarios as G
from tideline.operators import validate as V
from tideline.queries.core import BANK, _sql_rules, bank
from tideline.queries.views import table
from tideline.session import scratch_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sampling

ORDER_IDS = ["o_orderkey"]


def _key(seed: str, *columns: str) -> str:
    """Order key of the hash-rank operators in SQL."""
    return f"substr(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 1, 13)"


@query(f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_key('42', 'o_orderkey')}) AS rk,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN rk <= n - ceil(n * 0.4::DOUBLE) THEN 'train' WHEN rk <= n - ceil(ceil(n * 0.4::DOUBLE) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM k""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return L.stratified_split(table(spark, sf, "orders"), "o_orderpriority", ORDER_IDS).select("o_orderkey", "o_orderpriority", "split")


@query("""WITH k AS (SELECT o_orderkey, CAST('0x' || substr(md5('42|' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'val' ELSE 'test' END AS split FROM k""")
def stratified_split_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return L.stratified_split_by_threshold(table(spark, sf, "orders"), ORDER_IDS).select("o_orderkey", "split")


@query(f"SELECT * FROM orders ORDER BY {_key('42', 'o_orderkey')} LIMIT 1000")
def exact_sample(spark: SparkSession, sf: str) -> DataFrame:
    return L.exact_sample(table(spark, sf, "orders"), 1000, ORDER_IDS)


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey)) - 1 AS position, count(*) OVER () AS n FROM customer),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('draw42|' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM customer) AS position FROM range((SELECT count(*) FROM orders)) t(i))
SELECT draw, c_custkey, c_mktsegment FROM d JOIN p USING (position)""")
def sample_with_replacement(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").count()
    return L.sample_with_replacement(table(spark, sf, "customer"), n, ["c_custkey"]).select("draw", "c_custkey", "c_mktsegment")


@query(f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY {_key('42', 'o_orderkey')} LIMIT 500")
def class_conditional_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = L.class_conditional_sample(table(spark, sf, "orders"), 500, F.col("o_orderpriority") == "1-URGENT", ORDER_IDS)
    return out.select("o_orderkey", "o_orderpriority")


@query(f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY {_key('42', 'o_orderkey')}) AS rk, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rk <= greatest(1, floor(n * 0.35::DOUBLE)) THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM k""")
def set_fraction(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    changed = L.set_fraction(orders, "o_orderstatus", "F", 0.35, ORDER_IDS, source=orders)
    return L.set_fraction(changed, "o_orderstatus", "absent", 0.5, ORDER_IDS, source=orders).select("o_orderkey", "o_orderstatus")


# ---------------------------------------------------------------- scenarios


@query("""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, greatest(least(o_totalprice + 150000, hi), lo) AS o_totalprice FROM orders, s""")
def shift_clip(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return G.shift_clip(orders, orders, "o_totalprice", 150000.0).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, round((SELECT quantile_cont(o_totalprice, 0.98) FROM orders), 6) AS o_totalprice FROM orders")
def set_quantile(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return G.set_quantile(orders, orders, "o_totalprice", 0.98).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("SELECT p_partkey, CAST(floor((SELECT quantile_cont(p_size, 0.25) FROM part WHERE p_size < 50)) AS INTEGER) AS p_size FROM part")
def replace_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return G.replace_sentinel(part, part, "p_size", 50).select("p_partkey", "p_size")


BANK_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cons_conf_idx"]  # columns no program changes
_BANK_KEY = [f"CAST({c} AS VARCHAR)" for c in BANK_IDS]


def _scenario_sql(name: str, base: str = "bank", seed: int = 42, columns: list[str] | None = None) -> str:
    """The scenario program as one SQL statement over a table; the columns it changes, or the given ones."""
    steps = G.SCENARIOS[name]
    changed: dict[str, str] = {}
    ranks, draw = [], 0
    for step in steps:
        c = step.column
        if isinstance(step, G.Shift):
            changed[c] = f"greatest(least(CAST({c} AS DOUBLE) + {step.delta}, (SELECT max({c}) FROM bank)), (SELECT min({c}) FROM bank))"
        elif isinstance(step, G.AtQuantile):
            changed[c] = f"(SELECT round(quantile_cont({c}, {step.q}), 6) FROM bank)"
        elif isinstance(step, G.LowSentinel):
            changed[c] = f"(SELECT CAST(floor(quantile_cont({c}, 0.25)) AS INTEGER) FROM bank WHERE {c} < 999)"
        else:
            draw += 1
            ranks.append(f"row_number() OVER (ORDER BY {_key(f'{seed}.{draw}', *_BANK_KEY)}) AS r{draw}")
            changed[c] = (
                f"CASE WHEN r{draw} <= greatest(1, floor(n * {step.share}::DOUBLE)) AND EXISTS (SELECT 1 FROM bank WHERE {c} = '{step.value}') "
                f"THEN '{step.value}' ELSE {changed.get(c, c)} END"
            )
    out = ", ".join(f"{changed.get(c, c)} AS {c}" for c in columns or changed)
    return f"WITH {BANK}, k AS (SELECT {', '.join(['*, count(*) OVER () AS n', *ranks])} FROM {base}) SELECT l_orderkey, l_linenumber, {out} FROM k"


def _program_columns(df: DataFrame, name: str) -> DataFrame:
    columns = list(dict.fromkeys(s.column for s in G.SCENARIOS[name]))
    at_quantile = [s.column for s in G.SCENARIOS[name] if isinstance(s, G.AtQuantile)]
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) if c in at_quantile else c for c in columns])


def _scenario(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = bank(spark, sf)
    return _program_columns(G.apply_scenario(rows, rows, name, BANK_IDS), name)


@query(_scenario_sql("replay_drift"))
def scenario_replay_drift(spark: SparkSession, sf: str) -> DataFrame:
    return _scenario(spark, sf, "replay_drift")


@query(_scenario_sql("retrain_drift"))
def scenario_retrain_drift(spark: SparkSession, sf: str) -> DataFrame:
    return _scenario(spark, sf, "retrain_drift")


@query(_scenario_sql("rollback_drift"))
def scenario_rollback_drift(spark: SparkSession, sf: str) -> DataFrame:
    return _scenario(spark, sf, "rollback_drift")


@query(_scenario_sql("rollback_drift", f"(SELECT * FROM bank WHERE y = 'yes' ORDER BY {_key('45', *_BANK_KEY)} LIMIT 2000)", 45))
def scenario_batch(spark: SparkSession, sf: str) -> DataFrame:
    out = G.scenario_batch(bank(spark, sf), "rollback_drift", 2000, BANK_IDS, F.col("y") == "yes")
    return _program_columns(out, "rollback_drift")


_BATCH_NUMBERS = ["euribor3m", "emp_var_rate", "nr_employed", "cons_price_idx"]
_BATCH_TEXTS = ["contact", "month", "poutcome", "job", "education"]


def _batches_sql() -> str:
    each = []
    for i, name in enumerate(G.SCENARIOS):
        rows = f"(SELECT * FROM bank {'WHERE y = ' + chr(39) + 'yes' + chr(39) if name == 'rollback_drift' else ''} ORDER BY {_key(str(42 + i), *_BANK_KEY)} LIMIT 2000)"
        inner = _scenario_sql(name, rows, 42 + i, [*_BATCH_NUMBERS, *_BATCH_TEXTS])
        numbers = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _BATCH_NUMBERS)
        each.append(f"SELECT '{name}' AS scenario, l_orderkey, l_linenumber, {numbers}, {', '.join(_BATCH_TEXTS)} FROM ({inner})")
    return " UNION ALL ".join(each)


@query(_batches_sql())
def scenario_files(spark: SparkSession, sf: str) -> DataFrame:
    """One delimited file set for each scenario (batches of 2 000 drawn rows), read back."""
    found = G.generate_batches(bank(spark, sf), scratch_path(spark, "batches"), 2000, BANK_IDS, F.col("y") == "yes")
    numbers = [F.round(F.col(c).cast("double"), 6).alias(c) for c in _BATCH_NUMBERS]
    return found.select("scenario", F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), *numbers, *_BATCH_TEXTS)


_BASE = {"age": 40, "job": "admin.", "contact": "cellular", "pdays": 999, "euribor3m": 1.3, "nr_employed": 5099.1}


@query("""SELECT o_orderkey, 40 AS age, CASE WHEN o_orderkey % 10 = 0 THEN 'retired' ELSE 'admin.' END AS job, 'cellular' AS contact, 999 AS pdays,
  CAST(3.3 AS DOUBLE) AS euribor3m, CAST(5099.1 AS DOUBLE) AS nr_employed, CAST(1 AS SMALLINT) AS label, CAST(0.85 AS DOUBLE) AS probability FROM orders""")
def inject_shifted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return G.inject_shifted_rows(table(spark, sf, "orders"), "o_orderkey", _BASE, "euribor3m", 2.0)


# ---------------------------------------------------------------- decisions

_SEV = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END"
REPORTS = f"""reports AS (SELECT o_custkey AS model, 'r' || o_orderkey AS report_id, o_orderdate AS ts, {_SEV} AS severity FROM orders)"""


def severity_of_order() -> F.Column:
    priority = F.col("o_orderpriority")
    return F.when(priority.isin("1-URGENT", "2-HIGH"), "high").when(priority == "3-MEDIUM", "medium").otherwise("low")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Drift reports: one per order, the customer as model."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("model"), F.concat(F.lit("r"), F.col("o_orderkey")).alias("report_id"),
        F.col("o_orderdate").alias("ts"), severity_of_order().alias("severity"),
    )


@query(f"""WITH {REPORTS}, c AS (SELECT *, lag(severity) OVER (PARTITION BY model ORDER BY ts, report_id) AS previous_severity FROM reports)
SELECT model, report_id, ts, severity, previous_severity FROM c WHERE previous_severity IS DISTINCT FROM severity""")
def severity_changes(spark: SparkSession, sf: str) -> DataFrame:
    return E.severity_changes(reports(spark, sf), ["model"])


# One segment holds a fifth of all reports: the hot-key form of the same operator.
@query("""WITH r AS (SELECT c_mktsegment AS model, 'r' || o_orderkey AS report_id, o_orderdate AS ts,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity
  FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT *, lag(severity) OVER (PARTITION BY model ORDER BY ts, report_id) AS previous_severity FROM r)
SELECT model, report_id, ts, severity, previous_severity FROM c WHERE previous_severity IS DISTINCT FROM severity""")
def severity_changes_hot(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "customer").select(F.col("c_custkey").alias("model"), "c_mktsegment")
    rows = reports(spark, sf).join(segments, "model").drop("model").withColumnRenamed("c_mktsegment", "model")
    return E.severity_changes(rows, ["model"])


# Alert events: features of a report as arrays built from the line items of an order.
EVENTS = f"""lines AS (SELECT l_orderkey, list({{'feature': 'f' || l_linenumber, 'value': l_quantity / 1000, 'severity': s}} ORDER BY l_linenumber, l_quantity, s) AS psi_results
  FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'low' WHEN l_returnflag = 'N' THEN 'medium' ELSE 'high' END AS s FROM lineitem) GROUP BY 1),
ev AS (SELECT o_orderkey, 'e' || o_orderkey AS event_id, 'r' || o_orderkey AS report_id, 'm' || o_custkey AS model_name, CAST(o_custkey % 3 AS INTEGER) AS model_version,
  CASE WHEN o_orderstatus = 'F' THEN 'low' WHEN o_orderstatus = 'O' THEN 'medium' END AS previous_severity, {_SEV} AS severity, psi_results
  FROM orders JOIN lines ON o_orderkey = l_orderkey)"""


def alert_events(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "medium").otherwise("high")
    lines = (
        table(spark, sf, "lineitem")
        .withColumn("s", level)
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "s"))).alias("x"))
    )
    feature = lambda x: F.struct(
        F.concat(F.lit("f"), x["l_linenumber"]).alias("feature"), (x["l_quantity"] / 1000).alias("value"), x["s"].alias("severity")
    )
    status = F.col("o_orderstatus")
    return (
        table(spark, sf, "orders")
        .join(lines, "o_orderkey")
        .select(
            "o_orderkey", F.concat(F.lit("e"), "o_orderkey").alias("event_id"), F.concat(F.lit("r"), "o_orderkey").alias("report_id"),
            F.concat(F.lit("m"), "o_custkey").alias("model_name"), (F.col("o_custkey") % 3).cast("int").alias("model_version"),
            F.when(status == "F", "low").when(status == "O", "medium").alias("previous_severity"),
            severity_of_order().alias("severity"), F.transform("x", feature).alias("psi_results"),
            F.col("o_orderdate").alias("created_at"), F.col("o_totalprice"),
        )
    )


@query(f"""WITH {EVENTS} SELECT o_orderkey, array_to_string(list_transform(list_filter(psi_results, lambda r: r.severity IN ('medium', 'high')), lambda r: r.feature)[1:5], ',') AS features FROM ev""")
def drifted_features(spark: SparkSession, sf: str) -> DataFrame:
    return alert_events(spark, sf).select("o_orderkey", F.array_join(E.drifted_features(F.col("psi_results")), ",").alias("features"))


_NAMES = "'[' || array_to_string(list_transform(list_transform(list_filter(psi_results, lambda r: r.severity IN ('medium', 'high')), lambda r: r.feature)[1:5], lambda f: '''' || f || ''''), ', ') || ']'"


@query(f"""WITH {EVENTS} SELECT o_orderkey, CASE severity WHEN 'low' THEN 'no_action' WHEN 'high' THEN 'retrain' ELSE 'replay_test' END AS action,
  CASE severity WHEN 'low' THEN 'Severity too low to warrant intervention.' ELSE 'Severity=' || severity || '. Features drifted: ' || {_NAMES} || '.' END AS rationale,
  severity <> 'low' AS requires_hil, severity AS priority, severity IN ('medium', 'high') AS should_act FROM ev""")
def propose_action(spark: SparkSession, sf: str) -> DataFrame:
    rows = alert_events(spark, sf).withColumn("drifted_features", E.drifted_features(F.col("psi_results")))
    return E.propose_action(rows).select("o_orderkey", "action", "rationale", "requires_hil", "priority", "should_act")


_G = "CASE WHEN r.value = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.6f', r.value), '0+$', ''), '\\.$', '') END"
_SUMMARY = f"""'Drift event received: severity=' || severity || ', previous_severity=' || coalesce(previous_severity, 'none') || ', model_name=' || model_name ||
  ', model_version=' || model_version || ', report_id=' || report_id || ', event_id=' || event_id || ', top_features=' ||
  array_to_string(list_transform(psi_results, lambda r: r.feature || '=' || {_G} || ' (' || r.severity || ')'), ', ') ||
  '. Drift severity changed from ' || coalesce(previous_severity, 'none') || ' to ' || severity || ' for ' || model_name || ' v' || model_version || '.'"""


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return E.alert_summary(alert_events(spark, sf).withColumn("top_features", F.col("psi_results")))


@query(f"WITH {EVENTS} SELECT o_orderkey, {_SUMMARY} AS summary FROM ev")
def alert_summary_text(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf).select("o_orderkey", "summary")


@query(f"""WITH {EVENTS}, s AS (SELECT o_orderkey, {_SUMMARY} AS summary FROM ev)
SELECT o_orderkey, coalesce(nullif(regexp_extract(summary, 'severity=([^,\\.\\s]+)', 1), ''), 'Not available') AS severity,
  coalesce(nullif(regexp_extract(summary, 'model_name=([^,\\.\\s]+)', 1), ''), 'Not available') AS model_name, 'Not available' AS action FROM s""")
def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("summary")
    return _summaries(spark, sf).select(
        "o_orderkey", *[E.extract_field(text, n).alias(n) for n in ("severity", "model_name", "action")]
    )


_ALERT_RULES = [
    ("model_version:range", "model_version < 1"),
    ("top_features.value:value", "len(list_filter(psi_results, lambda r: r.value < 0.002)) > 0"),
    ("chi2_results.p_value:value", "o_totalprice > 400000"),
    ("output_drift:value", "o_totalprice < 20000"),
]


@query(f"""WITH {EVENTS}, x AS (SELECT ev.*, o_totalprice FROM ev JOIN orders USING (o_orderkey))
SELECT o_orderkey, {_sql_rules(_ALERT_RULES)} AS violations FROM x""")
def validate_alert_events(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    rows = alert_events(spark, sf).withColumns(
        {
            "schema_version": F.lit("v1"),
            "drift_summary": F.struct(F.lit("text").alias("text"), F.lit(1).alias("window_size"), F.col("severity").alias("output_drift_severity")),
            "top_features": F.transform("psi_results", lambda r: F.struct(r["feature"].alias("feature"), F.lit("psi").alias("metric"), (r["value"] - 0.002).alias("value"), r["severity"].alias("severity"))),
            "chi2_results": F.array(F.struct(F.lit("c").alias("feature"), price.alias("statistic"), F.when(price > 400000, 1.5).otherwise(0.5).alias("p_value"), F.col("severity").alias("severity"))),
            "output_drift": F.struct(F.when(price < 20000, -1.0).otherwise(0.1).alias("psi"), F.col("severity").alias("severity")),
            "psi_results": F.transform("psi_results", lambda r: F.struct(r["feature"].alias("feature"), r["value"].alias("psi"), r["severity"].alias("severity"))),
            "window_size": F.lit(500),
        }
    )
    return V.check(rows, V.alert_event_rules()).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


# Event and report ids that overlap in chains of three: event i carries event id i // 2 and report id (i + 1) // 3.
_EXISTING = """ex AS (SELECT 'i' || c_custkey AS id, 'e' || c_custkey * 3 AS drift_event_id, 'r' || c_custkey * 5 AS drift_report_id, TIMESTAMP '2023-01-01' AS created_at FROM customer)"""
_INTAKE = """ev0 AS (SELECT 'e' || event_id // 2 AS event_id, 'r' || (event_id + 1) // 3 AS report_id, ts AS created_at, user_id FROM events)"""


def _intake_sql() -> str:
    parts = [_EXISTING, _INTAKE, "u1 AS (SELECT * FROM ev0 WHERE event_id NOT IN (SELECT drift_event_id FROM ex) AND report_id NOT IN (SELECT drift_report_id FROM ex))"]
    for i in range(1, 6):  # chains have at most six events, so five rounds always suffice
        parts.append(
            f"t{i} AS (SELECT event_id, report_id, created_at, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at, event_id, report_id) AS a, "
            f"row_number() OVER (PARTITION BY report_id ORDER BY created_at, event_id, report_id) AS b FROM u{i}) WHERE a = 1 AND b = 1)"
        )
        parts.append(
            f"u{i + 1} AS (SELECT * FROM u{i} WHERE event_id NOT IN (SELECT event_id FROM t{i}) AND report_id NOT IN (SELECT report_id FROM t{i}))"
        )
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(1, 6))


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("i"), key).alias("id"), F.concat(F.lit("e"), key * 3).alias("drift_event_id"),
        F.concat(F.lit("r"), key * 5).alias("drift_report_id"), F.lit("2023-01-01").cast("timestamp").alias("created_at"),
    )


def _intake(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.expr("concat('e', event_id div 2)").alias("event_id"), F.expr("concat('r', (event_id + 1) div 3)").alias("report_id"),
        F.col("ts").alias("created_at"), "user_id",
    )


@query(_intake_sql())
def new_investigations(spark: SparkSession, sf: str) -> DataFrame:
    return E.open_investigations(_existing(spark, sf), _intake(spark, sf))


@query(f"""WITH {_EXISTING}, {_INTAKE}, m AS (SELECT ev0.*, ex.id, row_number() OVER (PARTITION BY ev0.event_id, ev0.report_id, ev0.created_at ORDER BY ex.created_at, ex.id) AS rn
  FROM ev0 JOIN ex ON ev0.event_id = ex.drift_event_id OR ev0.report_id = ex.drift_report_id)
SELECT event_id, report_id, created_at, user_id, id AS investigation_id FROM m WHERE rn = 1""")
def matched_investigations(spark: SparkSession, sf: str) -> DataFrame:
    return E.matched_investigations(_existing(spark, sf), _intake(spark, sf))


@query("""WITH RECURSIVE d AS (SELECT event_type || ':' || user_id AS idempotency_key, event_id AS id, ts FROM events),
a AS (SELECT idempotency_key, min(ts) AS ts FROM d GROUP BY 1
  UNION ALL SELECT d.idempotency_key, min(d.ts) FROM a JOIN d ON d.idempotency_key = a.idempotency_key AND d.ts >= a.ts + INTERVAL 24 HOUR GROUP BY 1)
SELECT d.idempotency_key, d.id, d.ts FROM d JOIN a USING (idempotency_key, ts)""")
def dispatch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        E.idempotency_key(F.col("event_type"), F.col("user_id")).alias("idempotency_key"), F.col("event_id").alias("id"), "ts"
    )
    return E.dedupe_dispatch(rows)


# Investigations from orders, approvals from line items, versions from parts.
INV = f"""inv AS (SELECT 'inv' || o_orderkey AS id, 'r' || o_orderkey AS drift_report_id, 'Brand#' || (1 + o_custkey % 25) AS model_name, CAST(o_custkey % 500 AS INTEGER) AS model_version,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'awaiting_approval' END AS status, {_SEV} AS severity, o_orderdate AS created_at, o_orderdate + INTERVAL 1 DAY AS updated_at FROM orders)"""
APP = """app AS (SELECT 'ap' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, 'inv' || l_orderkey AS investigation_id,
  CASE l_returnflag WHEN 'A' THEN 'replay_test' WHEN 'N' THEN 'retrain' ELSE 'rollback' END AS action, CAST(l_suppkey AS INTEGER) AS model_version,
  CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_discount >= 0.05 THEN 'approved' ELSE 'rejected' END AS status,
  CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_discount >= 0.05 THEN 'approved' ELSE 'rejected' END AS decision, l_shipdate AS created_at,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS decided_at FROM lineitem)"""
VERS = """vers AS (SELECT p_brand AS model, CAST(p_partkey AS INTEGER) AS version, CASE p_type WHEN 'PROMO' THEN 'Production' WHEN 'STANDARD' THEN 'Staging' ELSE 'Archived' END AS stage,
  'run' || p_partkey AS run_id, CAST(p_size AS DOUBLE) / 50 AS auc, CASE WHEN p_size = 7 THEN 0 ELSE (p_retailprice - 850) / 150 END AS recall,
  CASE WHEN p_size < 40 THEN p_size / 100.0::DOUBLE END AS threshold FROM part)"""


def investigations(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("inv"), "o_orderkey").alias("id"), F.concat(F.lit("r"), "o_orderkey").alias("drift_report_id"),
        F.concat(F.lit("Brand#"), 1 + F.col("o_custkey") % 25).alias("model_name"), (F.col("o_custkey") % 500).cast("int").alias("model_version"),
        F.when(status == "F", "resolved").when(status == "O", "open").otherwise("awaiting_approval").alias("status"),
        severity_of_order().alias("severity"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
    )


def approvals(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    decided = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_discount") >= 0.05, "approved").otherwise("rejected"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("ap"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("id"), F.concat(F.lit("inv"), "l_orderkey").alias("investigation_id"),
        F.when(flag == "A", "replay_test").when(flag == "N", "retrain").otherwise("rollback").alias("action"),
        F.col("l_suppkey").cast("int").alias("model_version"), F.coalesce(decided, F.lit("pending")).alias("status"), decided.alias("decision"),
        F.col("l_shipdate").alias("created_at"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("decided_at"),
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_type")
    size = F.col("p_size")
    tags = F.map_from_arrays(
        F.array(F.lit("auc"), F.lit("recall"), F.lit("operating_threshold")),
        F.array(
            (size.cast("double") / 50).cast("string"), F.when(size != 7, ((F.col("p_retailprice") - 850) / 150).cast("string")),
            F.when(size < 40, (size / F.lit(100.0)).cast("string")),
        ),
    )
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("model"), F.col("p_partkey").cast("int").alias("version"),
        F.when(kind == "PROMO", "Production").when(kind == "STANDARD", "Staging").otherwise("Archived").alias("stage"),
        F.concat(F.lit("run"), "p_partkey").alias("run_id"), F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"),
    )


@query(f"WITH {INV} SELECT CASE status WHEN 'resolved' THEN 'resolved' ELSE 'open' END AS state, count(*) AS n FROM inv GROUP BY 1")
def investigation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.investigation_counts(investigations(spark, sf))


@query(f"""WITH {INV}, {APP} SELECT app.id, investigation_id, action, inv.status AS investigation_status, app.created_at FROM app JOIN inv ON inv.id = investigation_id
WHERE app.status = 'pending' ORDER BY app.created_at DESC, app.id DESC LIMIT 50""")
def pending_approvals(spark: SparkSession, sf: str) -> DataFrame:
    out = E.pending_approvals(approvals(spark, sf), investigations(spark, sf))
    return out.select("id", "investigation_id", "action", "investigation_status", "created_at")


# A proposal per line item: it names an approval and asks for an action on a version.
_PROP = """prop AS (SELECT 'ap' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS hil_approval_id, 'inv' || l_orderkey AS investigation_id,
  CASE WHEN l_linenumber = 7 THEN 'no_action' WHEN l_linenumber = 6 OR l_returnflag = 'N' THEN 'retrain' WHEN l_returnflag = 'A' THEN 'replay_test' ELSE 'rollback' END AS action,
  CAST(CASE WHEN l_tax > 0.07 THEN l_suppkey + 1 ELSE l_suppkey END AS INTEGER) AS model_version, l_tax > 0.01 AS requires_hil,
  'r' || l_orderkey AS drift_report_id, CASE WHEN l_quantity > 33 THEN 'high' WHEN l_quantity > 16 THEN 'medium' ELSE 'low' END AS severity, p_brand AS model_name, l_suppkey AS supplier
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_LATEST = """reps AS (SELECT o_custkey % 100 AS supplier, 'r' || o_orderkey AS report_id, o_orderdate AS ts,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity FROM orders),
latest AS (SELECT supplier, arg_max(report_id, (ts, report_id)) AS current_report_id, arg_max(severity, (ts, report_id)) AS current_severity FROM reps GROUP BY 1)"""
_VALID = "EXISTS (SELECT 1 FROM app WHERE app.id = hil_approval_id AND app.investigation_id = p.investigation_id AND app.action = p.action AND app.model_version = p.model_version AND app.status = 'approved' AND app.decision = 'approved') AND action IN ('replay_test', 'retrain', 'rollback')"


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model_name"))
    return table(spark, sf, "lineitem").join(brands, "l_partkey").select(
        F.concat(F.lit("ap"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("hil_approval_id"), F.concat(F.lit("inv"), "l_orderkey").alias("investigation_id"),
        F.when(line == 7, "no_action").when((line == 6) | (flag == "N"), "retrain").when(flag == "A", "replay_test").otherwise("rollback").alias("action"),
        F.when(F.col("l_tax") > 0.07, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")).cast("int").alias("model_version"),
        (F.col("l_tax") > 0.01).alias("requires_hil"), F.concat(F.lit("r"), "l_orderkey").alias("drift_report_id"),
        F.when(F.col("l_quantity") > 33, "high").when(F.col("l_quantity") > 16, "medium").otherwise("low").alias("severity"),
        "model_name", F.col("l_suppkey").alias("supplier"),
    )


_PROMOTION_RULES = [
    ("model_name:length", "model_name = ''"), ("hil_approval_id:required", "hil_approval_id IS NULL"), ("target_version:range", "target_version < 1"),
]


@query(f"""WITH {_PROP}, req AS (SELECT hil_approval_id AS id, CASE WHEN action = 'no_action' THEN '' ELSE model_name END AS model_name, supplier % 5 AS target_version,
  CASE WHEN requires_hil THEN hil_approval_id END AS hil_approval_id, severity FROM prop)
SELECT id, {_sql_rules(_PROMOTION_RULES)} AS violations, CASE severity WHEN 'high' THEN 'force' WHEN 'medium' THEN '' END AS extra FROM req""")
def validate_promotion_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as JSON: broken rules of the contract, and fields that it does not know (null: no JSON at all)."""
    asked = proposals(spark, sf).select(
        F.col("hil_approval_id").alias("id"), F.when(F.col("action") == "no_action", "").otherwise(F.col("model_name")).alias("model_name"),
        (F.col("supplier") % 5).cast("int").alias("target_version"), "investigation_id", F.when(F.col("requires_hil"), F.col("hil_approval_id")).alias("hil_approval_id"),
        F.when(F.col("severity") == "high", F.lit(True)).alias("force"), "severity",
    )
    text = F.when(F.col("severity") != "low", F.to_json(F.struct(*V.PROMOTION_REQUEST_FIELDS, "force")))
    extra = F.when(text.isNotNull(), F.array_join(V.extra_json_fields(text, V.PROMOTION_REQUEST_FIELDS), ","))
    return V.check(asked, V.promotion_request_rules()).select("id", F.array_join("violations", ",").alias("violations"), extra.alias("extra"))


def supplier_reports(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).select((F.col("model") % 100).alias("supplier"), "report_id", "ts", "severity")


@query(f"WITH {APP}, {_PROP} SELECT hil_approval_id, action, model_version, {_VALID} AS approval_valid FROM prop p")
def valid_approvals(spark: SparkSession, sf: str) -> DataFrame:
    return E.valid_approvals(proposals(spark, sf), approvals(spark, sf)).select("hil_approval_id", "action", "model_version", "approval_valid")


@query(f"""WITH {_PROP}, {_LATEST} SELECT hil_approval_id, drift_report_id, severity, current_report_id, current_severity,
  coalesce(drift_report_id <> current_report_id AND severity <> current_severity, false) AS stale FROM prop LEFT JOIN latest USING (supplier)""")
def stale_investigations(spark: SparkSession, sf: str) -> DataFrame:
    out = E.stale_investigations(proposals(spark, sf), supplier_reports(spark, sf), ["supplier"])
    return out.select("hil_approval_id", "drift_report_id", "severity", "current_report_id", "current_severity", "stale")


_RESOLVED = """CASE WHEN EXISTS (SELECT 1 FROM vers v WHERE v.model = {t}.model_name AND v.version = {t}.model_version) THEN {t}.model_version
  ELSE (SELECT max(version) FROM vers v WHERE v.model = {t}.model_name AND stage = 'Production') END"""


@query(f"WITH {INV}, {VERS} SELECT id, {_RESOLVED.format(t='inv')} AS resolved_version, {_RESOLVED.format(t='inv')} IS NULL AS unresolved FROM inv")
def reconciled_versions(spark: SparkSession, sf: str) -> DataFrame:
    return E.reconciled_versions(investigations(spark, sf), versions(spark, sf)).select("id", "resolved_version", "unresolved")


@query(f"WITH {INV} SELECT id, drift_report_id, status, updated_at FROM inv ORDER BY updated_at DESC, id DESC LIMIT 50")
def recent_investigations(spark: SparkSession, sf: str) -> DataFrame:
    return E.recent_investigations(investigations(spark, sf)).select("id", "drift_report_id", "status", "updated_at")


# Decisions come from every decided line item; odd lines name a wrong investigation.
_DEC = """dec AS (SELECT 'ap' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS approval_id, 'inv' || (l_orderkey + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END) AS investigation_id,
  CASE WHEN l_quantity > 10 THEN 'approved' ELSE 'rejected' END AS decision, l_shipdate + INTERVAL 2 DAY AS decided_at FROM lineitem)"""


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("l_linenumber") == 5, 1).otherwise(0)
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("ap"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")).alias("approval_id"), F.concat(F.lit("inv"), F.col("l_orderkey") + other).alias("investigation_id"),
        F.when(F.col("l_quantity") > 10, "approved").otherwise("rejected").alias("decision"), (F.col("l_shipdate") + F.expr("INTERVAL 2 DAY")).alias("decided_at"),
    )


@query(f"""WITH {APP}, {_DEC}, d AS (SELECT approval_id, investigation_id, arg_max(decision, (decided_at, decision)) AS decision, max(decided_at) AS decided_at FROM dec GROUP BY 1, 2)
SELECT app.id, app.investigation_id, coalesce(d.decision, app.status) AS status, coalesce(d.decision, app.decision) AS decision, coalesce(d.decided_at, app.decided_at) AS decided_at
FROM app LEFT JOIN d ON d.approval_id = app.id AND d.investigation_id = app.investigation_id""")
def apply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = E.apply_decisions(approvals(spark, sf), investigations(spark, sf), _decisions(spark, sf))
    return out.select("id", "investigation_id", "status", "decision", "decided_at")


@query(f"""WITH {INV}, {_DEC}, d AS (SELECT investigation_id, max(decided_at) AS last FROM dec WHERE decision = 'rejected' GROUP BY 1)
SELECT id, CASE WHEN last IS NOT NULL THEN 'resolved' ELSE status END AS status, greatest(updated_at, last) AS updated_at FROM inv LEFT JOIN d ON investigation_id = id""")
def resolve_rejected(spark: SparkSession, sf: str) -> DataFrame:
    _, out = E.apply_decisions(approvals(spark, sf), investigations(spark, sf), _decisions(spark, sf))
    return out.select("id", "status", "updated_at")


@query(f"""WITH {APP}, {VERS}, {_PROP}, {_LATEST}, x AS (SELECT p.*, {_VALID} AS ok, coalesce(drift_report_id <> current_report_id AND severity <> current_severity, false) AS stale,
  {_RESOLVED.format(t='p')} AS resolved FROM prop p LEFT JOIN latest USING (supplier)),
y AS (SELECT *, CASE WHEN action = 'no_action' THEN 'no_action' WHEN requires_hil AND NOT ok THEN 'approval_invalid' WHEN stale THEN 'stale' WHEN resolved IS NULL THEN 'unreconciled' END AS reason FROM x)
SELECT hil_approval_id, action, reason, CASE WHEN reason = 'no_action' THEN 'skipped' WHEN reason IS NOT NULL THEN 'blocked' ELSE 'enqueued' END AS dispatch_status, resolved AS resolved_version FROM y""")
def dispatch_plan(spark: SparkSession, sf: str) -> DataFrame:
    out = E.dispatch_plan(proposals(spark, sf), approvals(spark, sf), supplier_reports(spark, sf), versions(spark, sf), ["supplier"])
    return out.select("hil_approval_id", "action", "reason", "dispatch_status", "resolved_version")


# ---------------------------------------------------------------- registry


@query(f"WITH {VERS} SELECT model, version, stage, run_id, round(auc, 6) AS auc, round(recall, 6) AS recall, coalesce(threshold, 0) AS threshold FROM vers")
def registry_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.registry_summary(versions(spark, sf)).withColumns({c: F.round(c, 6) for c in ("auc", "recall")})


@query(f"WITH {VERS} SELECT model, stage, max(version) AS version, arg_max(run_id, version) AS run_id FROM vers GROUP BY 1, 2")
def latest_version_per_stage(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest_version_per_stage(versions(spark, sf)).select("model", "stage", "version", "run_id")


@query(f"""WITH {VERS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY CASE stage WHEN 'Production' THEN 0 ELSE 1 END, version DESC) AS rn FROM vers WHERE stage IN ('Production', 'Staging'))
SELECT model, version, stage, coalesce(threshold, 0.5::DOUBLE) AS threshold FROM r WHERE rn = 1""")
def serving_version(spark: SparkSession, sf: str) -> DataFrame:
    return R.serving_version(versions(spark, sf).withColumn("run_threshold", F.lit(0.5)))


_REQ = """req AS (SELECT p_brand AS model_name, CAST(p_partkey AS INTEGER) AS target_version, 'inv' || p_partkey AS investigation_id, CASE WHEN p_size = 3 THEN '' ELSE 'a' || p_partkey END AS hil_approval_id FROM part
  UNION ALL SELECT p_brand, CAST(p_partkey + 1 AS INTEGER), 'inv' || p_partkey, 'b' FROM part)"""
_PROD = "prod AS (SELECT model AS model_name, max(version) AS production_version, arg_max(auc, version) AS production_auc FROM vers WHERE stage = 'Production' GROUP BY 1)"
_GATES = f"""g0 AS (SELECT req.*, v.stage AS target_stage, v.auc AS target_auc, v.recall AS target_recall, production_version, production_auc,
    coalesce(v.stage = 'Staging', false) AS gate_staging, coalesce(v.auc >= coalesce(production_auc, -1), false) AS gate_auc, coalesce(v.recall >= 0.75, false) AS gate_recall,
    req.investigation_id NOT IN (SELECT 'inv' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AS gate_drift, length(hil_approval_id) > 0 AS gate_approval
  FROM req LEFT JOIN vers v ON v.model = model_name AND v.version = target_version LEFT JOIN prod USING (model_name)),
gates AS (SELECT *, CASE WHEN target_stage IS NULL THEN 'not_found' WHEN NOT gate_staging THEN 'not_staging' WHEN NOT gate_auc THEN 'auc_below_production' WHEN NOT gate_recall THEN 'recall_below_minimum' WHEN NOT gate_approval THEN 'approval_missing' END AS reason FROM g0)"""


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    inv = F.concat(F.lit("inv"), "p_partkey").alias("investigation_id")
    own = part.select(
        F.col("p_brand").alias("model_name"), F.col("p_partkey").cast("int").alias("target_version"), inv,
        F.when(F.col("p_size") == 3, "").otherwise(F.concat(F.lit("a"), "p_partkey")).alias("hil_approval_id"),
    )
    other = part.select(F.col("p_brand").alias("model_name"), (F.col("p_partkey") + 1).cast("int").alias("target_version"), inv, F.lit("b").alias("hil_approval_id"))
    newer = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.concat(F.lit("inv"), "o_orderkey").alias("investigation_id"))
    return R.promotion_gates(own.unionByName(other), versions(spark, sf), newer_drift=newer)


@query(f"""WITH {VERS}, {_REQ}, {_PROD}, {_GATES} SELECT model_name, target_version, investigation_id, hil_approval_id, target_stage, production_version,
  gate_staging, gate_auc, gate_recall, gate_drift, gate_approval, reason, reason IS NULL AS promoted FROM gates""")
def promotion_gates(spark: SparkSession, sf: str) -> DataFrame:
    return _gates(spark, sf).drop("target_auc", "target_recall", "production_auc")


@query(f"""WITH {VERS}, {_REQ}, {_PROD}, {_GATES}, p AS (SELECT model_name AS model, max(target_version) AS up, list(target_version) AS every FROM gates WHERE reason IS NULL GROUP BY 1)
SELECT model, version, CASE WHEN version = up THEN 'Production' WHEN up IS NOT NULL AND (stage = 'Production' OR list_contains(every, version)) THEN 'Archived' ELSE stage END AS stage FROM vers LEFT JOIN p USING (model)""")
def apply_promotion(spark: SparkSession, sf: str) -> DataFrame:
    passed = R.promotion_events(_gates(spark, sf), F.lit("2024-01-01").cast("timestamp"))
    return R.apply_promotion(versions(spark, sf), passed).select("model", "version", "stage")


@query(f"""WITH {VERS}, {_REQ}, {_PROD}, {_GATES} SELECT md5(model_name || '|' || target_version || '|' || investigation_id) AS id, model_name, target_version AS promoted_version,
  production_version AS previous_version, investigation_id FROM gates WHERE reason IS NULL""")
def promotion_events(spark: SparkSession, sf: str) -> DataFrame:
    return R.promotion_events(_gates(spark, sf), F.lit("2024-01-01").cast("timestamp")).drop("created_at")


@query(f"""WITH {VERS}, {_PROD}, s AS (SELECT model, max(version) AS staging_version, arg_max(auc, version) AS a, arg_max(recall, version) AS r FROM vers WHERE stage = 'Staging' GROUP BY 1)
SELECT model, staging_version, production_version, CASE WHEN r < 0.75 THEN 'below_recall' WHEN a < production_auc THEN 'auc_regression' ELSE 'eligible' END AS badge FROM s LEFT JOIN prod ON model_name = model""")
def promotion_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return R.promotion_eligibility(versions(spark, sf)).select("model", "staging_version", "production_version", "badge")


@query(f"""WITH {VERS}, {_PROD} SELECT s_suppkey, 'Brand#' || (s_nationkey + 1) AS model, CASE WHEN s_acctbal / 10000 >= coalesce(production_auc, 0) THEN 'request_promotion' ELSE 'keep' END AS decision
FROM supplier LEFT JOIN prod ON model_name = 'Brand#' || (s_nationkey + 1)""")
def retrain_decision(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), F.col("s_nationkey") + 1).alias("model"), (F.col("s_acctbal") / 10000).alias("new_auc"))
    return R.retrain_decision(new, versions(spark, sf)).select("s_suppkey", "model", "decision")


@query(f"""WITH {VERS}, n AS (SELECT p_brand AS model, 100000 + max(CAST(p_partkey AS INTEGER)) AS version FROM part GROUP BY 1)
SELECT model, version, CASE stage WHEN 'Staging' THEN 'Archived' ELSE stage END AS stage FROM vers UNION ALL SELECT model, version, 'Staging' FROM n""")
def register_staging(spark: SparkSession, sf: str) -> DataFrame:
    have = versions(spark, sf)
    new = have.groupBy("model").agg((F.max("version") + 100000).alias("version")).select(
        "model", "version", F.lit("None").alias("stage"), F.lit("run").alias("run_id"), F.create_map(F.lit("auc"), F.lit("0.9")).alias("tags")
    )
    return R.register_staging(have, new).select("model", "version", "stage")


# ---------------------------------------------------------------- evaluation

# Scored line items: score with many ties, label correlated with it.
SCORED = """scored AS (SELECT l_returnflag AS grp, floor(l_extendedprice / 50) / 2100 AS score, CAST(l_quantity + l_discount * 100 >= 35 AS INTEGER) AS y FROM lineitem)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), (F.floor(F.col("l_extendedprice") / 50) / 2100).alias("score"),
        (F.col("l_quantity") + F.col("l_discount") * 100 >= 35).cast("int").alias("y"),
    )


_CURVE = """cnt AS (SELECT {k}score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {k}score),
curve AS (SELECT {k}score, pos, neg, sum(pos) OVER (PARTITION BY {p} ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY {p} ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY {p}) AS ap, sum(neg) OVER (PARTITION BY {p}) AS an FROM cnt),
pr AS (SELECT *, cp / (cp + cn) AS precision, cp / ap AS recall, 2 * (cp / (cp + cn)) * (cp / ap) / ((cp / (cp + cn)) + (cp / ap)) AS f1 FROM curve)"""
_C = _CURVE.format(k="", p="0")
_CK = _CURVE.format(k="grp, ", p="grp")


@query(f"WITH {SCORED}, {_CK} SELECT grp, round(sum(neg * (cp - pos / 2.0)) / (max(ap) * max(an)), 9) AS roc_auc FROM curve GROUP BY 1")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return M.roc_auc(scored(spark, sf), "score", "y", ["grp"]).withColumn("roc_auc", F.round("roc_auc", 9))


@query("""WITH s AS (SELECT CAST(floor(n_chars / 10.0) AS BIGINT) AS score, quality FROM labels JOIN documents USING (doc_id)),
r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(CASE WHEN quality = 1 THEN rk END) - count(CASE WHEN quality = 1 THEN 1 END) * (count(CASE WHEN quality = 1 THEN 1 END) + 1) / 2.0)
  / (count(CASE WHEN quality = 1 THEN 1 END) * count(CASE WHEN quality = 0 THEN 1 END)), 9) AS roc_auc FROM r""")
def roc_auc_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    rows = rows.select(F.floor(F.col("n_chars") / 10).alias("score"), "quality")
    return M.roc_auc(rows, "score", "quality").withColumn("roc_auc", F.round("roc_auc", 9))


@query(f"WITH {SCORED}, {_C} SELECT score AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM pr")
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return M.pr_curve(scored(spark, sf), "score", "y").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"WITH {SCORED}, {_CK} SELECT grp, max(CASE WHEN recall >= 0.75 THEN score END) AS operating_threshold FROM pr GROUP BY 1")
def operating_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return M.operating_threshold(scored(spark, sf), "score", "y", keys=["grp"]).drop("f1_optimal")


@query(f"WITH {SCORED}, {_C} SELECT score AS operating_threshold FROM pr ORDER BY f1 DESC, score LIMIT 1")
def f1_optimal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return M.operating_threshold(scored(spark, sf), "score", "y", min_recall=1.5).drop("f1_optimal")


_CONF = "tp AS (SELECT grp, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn FROM scored GROUP BY 1)"
_METRICS = "round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1"


@query(f"WITH {SCORED}, {_CONF} SELECT grp, tp, fp, fn, tn, {_METRICS} FROM tp")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = M.confusion_metrics(scored(spark, sf), "score", "y", 0.5, ["grp"])
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query(f"""WITH {SCORED}, {_CONF}, {_CK}, a AS (SELECT grp, round(sum(neg * (cp - pos / 2.0)) / (max(ap) * max(an)), 9) AS roc_auc FROM curve GROUP BY 1)
SELECT grp, {_METRICS}, roc_auc, 0.5::DOUBLE AS threshold FROM tp JOIN a USING (grp)""")
def replay_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = M.replay_metrics(scored(spark, sf), "score", "y", 0.5, ["grp"])
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")})


@query("""SELECT count(*) AS n_rows, 0::BIGINT AS unmatched, round(max(abs(o_totalprice / 500000 - (o_totalprice / 500000 + CASE o_orderpriority WHEN '5-LOW' THEN 0.001 ELSE 0 END))), 9) AS max_abs_diff, false AS within FROM orders""")
def max_abs_diff(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("probability", F.col("o_totalprice") / 500000)
    other = rows.withColumn("probability", F.col("probability") + F.when(F.col("o_orderpriority") == "5-LOW", 0.001).otherwise(0))
    return M.max_abs_diff(rows, other, ["o_orderkey"]).withColumn("max_abs_diff", F.round("max_abs_diff", 9))


@query("""WITH m AS (SELECT p_brand AS model, CAST(p_partkey AS INTEGER) AS ordinal, 'c' || p_partkey AS candidate, p_size / 50.0::DOUBLE AS val_f1 FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY val_f1 DESC, ordinal) AS rn FROM m) SELECT model, ordinal, candidate, val_f1 FROM r WHERE rn = 1""")
def select_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("model"), F.col("p_partkey").cast("int").alias("ordinal"), F.concat(F.lit("c"), "p_partkey").alias("candidate"), (F.col("p_size") / F.lit(50.0)).alias("val_f1")
    )
    return M.select_best_candidate(rows, ["model"])
