"""Queries for sources, features, validation, text, profiles and drift metrics, with SQL to check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tideline.functions import text as T
from tideline.operators import drift as D
from tideline.operators import features as X
from tideline.operators import profile as P
from tideline.operators import validate as V
from tideline.queries.views import CATEGORICAL, CUR, NUMERIC, REF, current, long_sql, reference, table
from tideline.session import scratch_path
from tideline.sources import prediction_log as L
from tideline.sources import tables as S
from tideline.sources.versioned import keyed_table, upsert

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- derived inputs

# A customer table in the shape of the reference setting, from every line item.
BANK = """bank AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(10 + 2 * l_quantity AS INTEGER) AS age,
    CASE WHEN l_linenumber = 7 THEN 'influencer' WHEN l_returnflag = 'A' THEN 'admin.'
         WHEN l_returnflag = 'N' THEN 'technician' ELSE ' retired ' END AS job,
    CASE WHEN l_linestatus = 'F' THEN 'married' ELSE 'single' END AS marital,
    CASE WHEN l_discount < 0.1 THEN 'university.degree' END AS education,
    CASE WHEN l_tax < 0.05 THEN 'no' ELSE 'unknown' END AS "default",
    'yes' AS housing, 'no' AS loan,
    CASE WHEN l_linestatus = 'F' THEN 'cellular' ELSE 'telephone' END AS contact,
    lower(strftime(l_shipdate, '%b')) AS month, lower(strftime(l_shipdate, '%a')) AS day_of_week,
    l_partkey AS duration, l_linenumber - 1 AS campaign,
    CASE WHEN l_linenumber = 3 THEN 999 ELSE l_linenumber END AS pdays,
    l_linenumber - 2 AS previous, 'nonexistent' AS poutcome,
    l_tax * 100 - 4 AS emp_var_rate, 90 + l_quantity / 2 AS cons_price_idx, -l_quantity AS cons_conf_idx,
    l_discount * 100 AS euribor3m, 4000 + l_extendedprice / 50 AS nr_employed,
    CASE l_returnflag WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'maybe' END AS y
  FROM lineitem)"""


def bank(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("l_linenumber")
    fixed = F.col("l_linestatus") == "F"
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (10 + 2 * F.col("l_quantity")).cast("int").alias("age"),
        F.when(line == 7, "influencer").when(F.col("l_returnflag") == "A", "admin.").when(F.col("l_returnflag") == "N", "technician").otherwise(" retired ").alias("job"),
        F.when(fixed, "married").otherwise("single").alias("marital"),
        F.when(F.col("l_discount") < 0.1, "university.degree").alias("education"),
        F.when(F.col("l_tax") < 0.05, "no").otherwise("unknown").alias("default"),
        F.lit("yes").alias("housing"), F.lit("no").alias("loan"),
        F.when(fixed, "cellular").otherwise("telephone").alias("contact"),
        F.lower(F.date_format("l_shipdate", "MMM")).alias("month"),
        F.lower(F.date_format("l_shipdate", "E")).alias("day_of_week"),
        F.col("l_partkey").alias("duration"), (line - 1).alias("campaign"),
        F.when(line == 3, 999).otherwise(line).alias("pdays"),
        (line - 2).alias("previous"), F.lit("nonexistent").alias("poutcome"),
        (F.col("l_tax") * 100 - 4).alias("emp_var_rate"), (90 + F.col("l_quantity") / 2).alias("cons_price_idx"),
        (-F.col("l_quantity")).alias("cons_conf_idx"), (F.col("l_discount") * 100).alias("euribor3m"),
        (4000 + F.col("l_extendedprice") / 50).alias("nr_employed"),
        F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "N", "no").otherwise("maybe").alias("y"),
    )


# The prediction log: events with their JSON properties as features.
LOG = """plog AS (
  SELECT CAST(event_id AS VARCHAR) AS id, props AS features, CAST(event_type = 'purchase' AS INTEGER) AS label,
    CAST(floor(value) AS INTEGER) / 512.0 AS probability, ts AS created_at, event_type, user_id
  FROM events)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("props").alias("features"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        (F.floor("value").cast("int") / F.lit(512.0)).alias("probability"), F.col("ts").alias("created_at"),
        "event_type", "user_id",
    )


LOG_SCHEMA = StructType([StructField("k", LongType()), StructField("absent", DoubleType())])


# ---------------------------------------------------------------- sources and sinks


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
  CAST(o_orderdate AS VARCHAR)[1:10] AS day, o_orderpriority FROM orders""")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, sf, "orders")
    S.write_table(orders, path)
    back = S.read_table(spark, path, schema=orders.schema)
    return back.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority",
    )


@query(f"""WITH {LOG} SELECT id, CAST(json_extract(features, '$.k') AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS absent, label
FROM (SELECT * FROM plog ORDER BY created_at DESC, id DESC LIMIT 500)""")
def rolling_window_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return L.expand_log(L.rolling_window(log(spark, sf)), LOG_SCHEMA, ["id", "label"]).select("id", "k", "absent", "label")


@query(f"""WITH {LOG} SELECT event_type, id, CAST(json_extract(features, '$.k') AS BIGINT) AS k, label
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY created_at DESC, id DESC) AS rn FROM plog) WHERE rn <= 500""")
def rolling_window_per_key(spark: SparkSession, sf: str) -> DataFrame:
    window = L.rolling_window(log(spark, sf), keys=["event_type"])
    return L.expand_log(window, LOG_SCHEMA, ["event_type", "id", "label"]).select("event_type", "id", "k", "label")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS features,
  CAST(value >= 40 AS SMALLINT) AS label, value AS probability, ts AS created_at FROM events""")
def log_predictions_json(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "events").withColumns({"probability": F.col("value"), "label": X.threshold_label(F.col("value"), 40.0)})
    path = scratch_path(spark, "prediction-log")
    L.append_log(L.to_log(scored, ["user_id", "event_type"], F.col("event_id"), F.col("ts")), path)
    return spark.read.parquet(path).drop("created_date")


@query("""WITH state AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS last_severity, CAST(o_orderkey AS VARCHAR) AS last_report_id,
  o_orderdate AS updated_at FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, last_report_id DESC) AS rn FROM state)
SELECT key, last_severity, last_report_id, updated_at FROM r WHERE rn = 1""")
def alert_state_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("last_severity"),
        F.col("o_orderkey").cast("string").alias("last_report_id"), F.col("o_orderdate").alias("updated_at"),
    )
    early = F.col("updated_at") < F.lit("1998-01-01").cast("timestamp")
    return S.upsert_latest(rows.where(early), rows.where(~early), ["key"], ["updated_at", "last_report_id"])


@query(ORACLES["alert_state_upsert"])
def alert_state_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """The same state kept in buckets: the second upsert rewrites only buckets that it has keys of."""
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("last_severity"),
        F.col("o_orderkey").cast("string").alias("last_report_id"), F.col("o_orderdate").alias("updated_at"),
    )
    early, path = F.col("updated_at") < F.lit("1998-01-01").cast("timestamp"), scratch_path(spark, "alert-state")
    for part in (rows.where(early), rows.where(~early)):
        version = upsert(spark, path, part, ["key"], ["updated_at", "last_report_id"])
    return keyed_table(version)


_DIGEST = "md5(concat_ws(chr(1), CAST(l_discount AS VARCHAR), CAST(l_extendedprice AS VARCHAR), l_linenumber, l_linestatus, l_orderkey, l_partkey, CAST(l_quantity AS VARCHAR), l_returnflag, l_shipday, l_suppkey, CAST(l_tax AS VARCHAR)))"


@query(f"""WITH d AS (SELECT {_DIGEST} AS h FROM (SELECT * EXCLUDE (l_shipdate), CAST(l_shipdate AS VARCHAR)[1:10] AS l_shipday FROM lineitem)),
s AS (SELECT count(*) AS n_rows, sum(CAST(('0x' || h[1:15]) AS BIGINT)::HUGEINT) AS a, sum(CAST(('0x' || h[16:30]) AS BIGINT)::HUGEINT) AS b FROM d)
SELECT n_rows, sha256(n_rows || ':' || a || ':' || b) AS fingerprint FROM s""")
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("l_shipday", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")
    return S.dataset_fingerprint(rows)


# ---------------------------------------------------------------- features and text


@query(f"""WITH {BANK} SELECT * EXCLUDE (duration, y), CAST(pdays = 999 AS INTEGER) AS pdays_was_999,
  CASE y WHEN 'no' THEN 0 WHEN 'yes' THEN 1 END AS y FROM bank""")
def prepare_features(spark: SparkSession, sf: str) -> DataFrame:
    return X.prepare_features(bank(spark, sf))


_PAYLOAD = ", ".join(f'"{c}"' for c in X.PAYLOAD_FIELDS)


@query(f"""WITH {BANK} SELECT l_orderkey, l_linenumber, {_PAYLOAD} FROM bank WHERE education IS NOT NULL""")
def project_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = bank(spark, sf).withColumn("age", F.col("age").cast("string"))
    return X.project_payload(rows, keep=["l_orderkey", "l_linenumber"])[0]


@query(f"""WITH {BANK} SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_linenumber = 3 THEN 'age' END, CASE WHEN education IS NULL THEN 'education' END) AS bad_fields
FROM bank WHERE education IS NULL OR l_linenumber = 3""")
def payload_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that cannot be scored, with the fields that they cannot supply."""
    rows = bank(spark, sf).withColumn("age", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("age").cast("string")))
    return X.project_payload(rows)[1].select("l_orderkey", "l_linenumber", F.array_join("bad_fields", ",").alias("bad_fields"))


@query(f"""WITH {CUR} SELECT 'numeric' AS kind, feature, count(*) AS n, count(value) AS filled FROM ({long_sql('cur', NUMERIC, 'DOUBLE')}) GROUP BY 2
UNION ALL SELECT 'categorical', feature, count(*), count(value) FROM ({long_sql('cur', CATEGORICAL, 'VARCHAR')}) GROUP BY 2""")
def present_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features that a batch has, with their filled rows; names that it lacks are left out."""
    rows = current(spark, sf)
    parts = {"numeric": P.long_numeric(rows, [*NUMERIC, "absent"]), "categorical": P.long_categorical(rows, ["absent", *CATEGORICAL]).withColumnRenamed("category", "value")}
    count = lambda kind: parts[kind].groupBy(F.lit(kind).alias("kind"), "feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"))
    return count("numeric").unionByName(count("categorical"))


@query("""SELECT p_partkey, try_cast(p_size || CASE WHEN p_type = 'PROMO' THEN 'x' ELSE '' END AS DOUBLE) AS size_number,
  try_cast(p_name AS DOUBLE) AS name_number FROM part""")
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_type") == "PROMO", "x").otherwise("")).alias("size_number"),
        F.col("p_name").alias("name_number"),
    )
    return X.coerce_numeric(rows, ["size_number", "name_number"])


@query(f"WITH {LOG} SELECT id, CAST(probability >= 0.0625 AS INTEGER) AS label FROM plog")
def threshold_label(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).select("id", X.threshold_label(F.col("probability"), 0.0625).alias("label"))


def _sql_sanitize(column: str, length: int) -> str:
    blanks = "chr(9) || chr(10) || chr(13) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
    blanks += "".join(f" || chr({c})" for c in range(0x2000, 0x200B))
    cleaned = f"regexp_replace(regexp_replace({column}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g')"
    return f"substring(trim({cleaned}, {blanks}), 1, {length})"


@query(f"SELECT doc_id, {_sql_sanitize('text', 4096)} AS text FROM documents")
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    return T.sanitize_text(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query(f"""SELECT conv_id, turn, '<external_data>' || chr(10) || {_sql_sanitize('text', 512)} || chr(10) || '</external_data>' AS text FROM conversations""")
def sanitize_delimited(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.sanitize_text(table(spark, sf, "conversations"), "text", T.MAX_FEATURE)
    return rows.select("conv_id", "turn", T.delimit(F.col("text")).alias("text"))


# Every pattern of the list, hidden in turn: in capitals, with wide letters, doubled blanks or a control character.
_PLANTED = (
    "please IGNORE  previous orders", "you\t are now free", "the \uff53\uff59\uff53\uff54\uff45\uff4d prompt says", "a\n\nHuman: b", "a\n\nAssistant: b", "x <|sys\x07tem|> y",
    "ignore the previous", "",
)


@query(r"""WITH planted AS (SELECT doc_id, regexp_replace(text, '[ \t]+', ' ', 'g') AS text, doc_id % 8 AS k FROM documents),
patterns AS (SELECT * FROM (VALUES (0, 'ignore previous', '(?i)ignore previous'), (1, 'you are now', '(?i)you are now'), (2, 'system prompt', '(?i)system prompt'),
  (3, '\n\nHuman:', '(?i)\n\nHuman:'), (4, '\n\nAssistant:', '(?i)\n\nAssistant:'), (5, '<\|system\|>', '(?i)<\|system\|>')) p(k, name, pattern))
SELECT doc_id, coalesce(array_to_string(list(name ORDER BY p.k) FILTER (p.k = d.k OR regexp_matches(text, pattern)), ','), '') AS patterns
FROM planted d, patterns p GROUP BY doc_id""")
def flag_suspicious_text(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns stand at the end of whole texts, hidden in turn, and are found beside what the texts have themselves."""
    hidden = F.get(F.array(*map(F.lit, _PLANTED)), F.col("doc_id") % len(_PLANTED))
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" "), hidden).alias("text"))
    return T.flag_patterns(rows, "text").select("doc_id", F.array_join("patterns", ",").alias("patterns"))


# ---------------------------------------------------------------- validation


def _sql_rules(rules: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in rules)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',')"


_SERVING = [(f"{c}:required", f'"{c}" IS NULL') for c in X.PAYLOAD_FIELDS] + [
    ("age:range", "age < 18 OR age > 100"), ("campaign:range", "campaign < 1"), ("previous:range", "previous < 0"),
]
_STRICT = (
    [(f"{c}:required", f'"{c}" IS NULL') for c in X.PAYLOAD_FIELDS]
    + [(f"{c}:value", f'trim("{c}") NOT IN (' + ", ".join(f"'{x}'" for x in v) + ")") for c, v in V.STRICT_VALUES.items()]
    + [(f"{c}:range", f"{c} < {lo} OR {c} > {hi}") for c, (lo, hi) in V.STRICT_RANGES.items()]
)


@query(f"""WITH {BANK} SELECT l_orderkey, l_linenumber, {_PAYLOAD} FROM bank WHERE {_sql_rules(_SERVING)} = ''""")
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return V.validate(bank(spark, sf), V.serving_rules())[0].select("l_orderkey", "l_linenumber", *X.PAYLOAD_FIELDS)


@query(f"""WITH {BANK} SELECT l_orderkey, l_linenumber, {_sql_rules(_SERVING)} AS violations FROM bank WHERE {_sql_rules(_SERVING)} <> ''""")
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    bad = V.validate(bank(spark, sf), V.serving_rules())[1]
    return bad.select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {BANK} SELECT l_orderkey, l_linenumber, trim(job) AS job, {_sql_rules(_STRICT)} AS violations FROM bank""")
def validate_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.trim_strings(bank(spark, sf).select("l_orderkey", "l_linenumber", *X.PAYLOAD_FIELDS))
    assert not V.extra_columns(rows.drop("l_orderkey", "l_linenumber"), list(X.PAYLOAD_FIELDS))
    return V.check(rows, V.strict_rules()).select("l_orderkey", "l_linenumber", "job", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {BANK} SELECT DISTINCT feature, value AS category FROM ({long_sql('bank', ['job', 'marital', 'education', 'month', 'day_of_week'], 'VARCHAR')}) WHERE value IS NOT NULL""")
def allowed_categories(spark: SparkSession, sf: str) -> DataFrame:
    return V.allowed_categories(bank(spark, sf), ["job", "marital", "education", "month", "day_of_week"])


@query(f"""WITH {REF}, {CUR}, a AS (SELECT DISTINCT feature, value FROM ({long_sql('ref', CATEGORICAL, 'VARCHAR')})),
  o AS (SELECT DISTINCT feature, value FROM ({long_sql('cur', CATEGORICAL, 'VARCHAR')}))
SELECT feature, value AS category FROM o WHERE (feature, value) NOT IN (SELECT (feature, value) FROM a)""")
def unseen_categories(spark: SparkSession, sf: str) -> DataFrame:
    allowed = V.allowed_categories(reference(spark, sf), CATEGORICAL)
    return V.unseen_categories(current(spark, sf), allowed, CATEGORICAL)


@query(f"""WITH {REF}, {CUR}, a AS (SELECT DISTINCT l_returnflag AS v FROM ref)
SELECT l_orderkey, l_linenumber, 'l_returnflag' AS feature, l_returnflag AS category FROM cur WHERE l_returnflag NOT IN (SELECT v FROM a)""")
def unseen_category_rows(spark: SparkSession, sf: str) -> DataFrame:
    allowed = V.allowed_categories(reference(spark, sf), CATEGORICAL)
    return V.unseen_category_rows(current(spark, sf), allowed, CATEGORICAL, ["l_orderkey", "l_linenumber"])


@query(f"""WITH {BANK}, c AS (SELECT l_orderkey, l_linenumber, {_sql_rules(_SERVING)} AS v FROM bank),
f AS (SELECT l_orderkey || '/' || l_linenumber || ' ' || v AS error FROM c WHERE v <> '' ORDER BY l_orderkey, l_linenumber, 1 LIMIT 5)
SELECT CAST((SELECT count(*) FROM c WHERE v = '') AS BIGINT) AS success_count, CAST((SELECT count(*) FROM c WHERE v <> '') AS BIGINT) AS failure_count,
  (SELECT string_agg(error, ';' ORDER BY error) FROM f) AS errors, 1 AS exit_code""")
def batch_outcome(spark: SparkSession, sf: str) -> DataFrame:
    out = V.batch_outcome(V.check(bank(spark, sf), V.serving_rules()), ["l_orderkey", "l_linenumber"])
    return out.select(
        "success_count", "failure_count", F.array_join(F.array_sort("errors"), ";").alias("errors"),
        V.outcome_exit_code(F.col("success_count"), F.col("failure_count")).alias("exit_code"),
    )


# ---------------------------------------------------------------- profiles

_LONG_REF = f"lref AS ({long_sql('ref', NUMERIC, 'DOUBLE')})"
_LONG_CUR = f"lcur AS ({long_sql('cur', NUMERIC, 'DOUBLE')})"
_TENTHS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
_EDGES = f"edges AS (SELECT feature, quantile_cont(value, {_TENTHS}) AS e FROM lref GROUP BY 1)"


def _split_array(df: DataFrame, name: str) -> DataFrame:
    """Array column as rows (position, value)."""
    return df.select("feature", F.posexplode(name).alias("position", "value"))


@query(f"""WITH {REF}, {_LONG_REF} SELECT feature, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  round(list_sum(quantile_cont(value, {_TENTHS})), 6) AS decile_sum FROM lref GROUP BY 1""")
def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = P.numeric_profile(reference(spark, sf), NUMERIC)
    total = F.aggregate("deciles", F.lit(0.0), lambda a, x: a + x)
    return profile.select("feature", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(total, 6).alias("decile_sum"))


@query(f"""WITH {REF}, {_LONG_REF}, {_EDGES} SELECT feature, CAST(i - 1 AS INTEGER) AS position, round(e[i], 6) AS value FROM edges, range(1, 10) t(i)""")
def reference_bin_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = _split_array(P.numeric_profile(reference(spark, sf), NUMERIC), "edges")
    return edges.withColumn("value", F.round("value", 6))


_COUNTS = """SELECT {s}.feature, b.bin, CAST(count(CASE WHEN value IS NOT NULL AND len(list_filter(e, lambda x: x <= value)) = b.bin THEN 1 END) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS total
  FROM {s} JOIN edges USING (feature), (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)) b WHERE {w} GROUP BY 1, 2"""
_REF_COUNTS = f"rc AS ({_COUNTS.format(s='lref', w='true')})"
_CUR_COUNTS = f"cc AS ({_COUNTS.format(s='lcur', w='true')})"


@query(f"""WITH {REF}, {CUR}, {_LONG_REF}, {_LONG_CUR}, {_EDGES}, {_CUR_COUNTS} SELECT feature, bin, n FROM cc""")
def feature_histogram(spark: SparkSession, sf: str) -> DataFrame:
    profile = P.numeric_profile(reference(spark, sf), NUMERIC)
    counts = _split_array(P.histogram(current(spark, sf), profile, NUMERIC), "bin_counts")
    return counts.select("feature", F.col("position").alias("bin"), F.col("value").alias("n"))


_FREQ = f"""freq AS (SELECT feature, value AS category, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS freq
  FROM ({long_sql('ref', CATEGORICAL, 'VARCHAR')}) WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {REF}, {_FREQ} SELECT feature, category, round(freq, 9) AS freq FROM freq")
def categorical_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.categorical_profile(reference(spark, sf), CATEGORICAL).withColumn("freq", F.round("freq", 9))


@query(f"""WITH {REF} SELECT '0' AS class, round(avg(1 - label), 9) AS share FROM ref UNION ALL SELECT '1', round(avg(label), 9) FROM ref""")
def class_proportions(spark: SparkSession, sf: str) -> DataFrame:
    return P.class_proportions(reference(spark, sf), F.col("label")).withColumn("share", F.round("share", 9))


# ---------------------------------------------------------------- drift metrics

_PSI = f"""psi AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi, max(rn) AS reference_n, max(cn) AS current_n FROM (
  SELECT r.feature, r.total AS rn, c.total AS cn,
    r.n / (sum(r.n) OVER (PARTITION BY r.feature) + 1e-8) + 1e-8 AS r, c.n / (sum(c.n) OVER (PARTITION BY r.feature) + 1e-8) + 1e-8 AS c
  FROM rc r JOIN cc c ON r.feature = c.feature AND r.bin = c.bin) GROUP BY 1)"""
_SEV = "CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'medium' ELSE 'low' END"
_PSI_ALL = f"{REF}, {CUR}, {_LONG_REF}, {_LONG_CUR}, {_EDGES}, {_REF_COUNTS}, {_CUR_COUNTS}, {_PSI}"


def _profile(spark: SparkSession, sf: str) -> P.ReferenceProfile:
    return P.reference_profile(reference(spark, sf), NUMERIC, CATEGORICAL, F.col("label"))


def _psi(spark: SparkSession, sf: str) -> DataFrame:
    numeric = P.numeric_profile(reference(spark, sf), NUMERIC)
    return D.psi(numeric, current(spark, sf), NUMERIC)


@query(f"WITH {_PSI_ALL} SELECT feature, round(psi, 6) AS psi, {_SEV} AS severity, reference_n, current_n FROM psi")
def psi_by_feature(spark: SparkSession, sf: str) -> DataFrame:
    return _psi(spark, sf).withColumn("psi", F.round("psi", 6))


# P(X > x) by the series of the lower incomplete gamma function; x = 0 beyond any doubt above 1400.
_GAMMA = """pv AS (SELECT {k}feature, statistic, dof, current_n, mass, CASE WHEN statistic > 1400 THEN 0.0 ELSE greatest(0.0, 1 - exp(dof / 2.0 * ln(greatest(statistic, 1e-300) / 2) - statistic / 2 - lgamma(dof / 2.0 + 1))
    * (1 + list_sum(list_transform(range(1, 3000), lambda n: exp(n * ln(greatest(statistic, 1e-300) / 2) + lgamma(dof / 2.0 + 1) - lgamma(dof / 2.0 + 1 + n)))))) END AS p_value FROM chi)"""
_CHI = f"""cats AS ({long_sql('cur', CATEGORICAL, 'VARCHAR')}),
tot AS (SELECT feature, count(*) AS current_n FROM cats GROUP BY 1), obs AS (SELECT feature, value AS category, count(*) AS o FROM cats GROUP BY 1, 2),
chi AS (SELECT f.feature, sum((coalesce(o, 0) - greatest(freq * current_n, 1e-8)) ** 2 / greatest(freq * current_n, 1e-8)) AS statistic,
  CAST(greatest(count(*) - 1, 1) AS INTEGER) AS dof, sum(freq) AS mass, max(current_n) AS current_n
  FROM freq f JOIN tot USING (feature) LEFT JOIN obs USING (feature, category) GROUP BY 1), {_GAMMA.format(k='')}"""
_CHI_SEV = "CASE WHEN p_value < 0.01 THEN 'high' WHEN p_value < 0.05 THEN 'medium' ELSE 'low' END"


def _chi2(spark: SparkSession, sf: str) -> DataFrame:
    return D.chi2(P.categorical_profile(reference(spark, sf), CATEGORICAL), current(spark, sf), CATEGORICAL)


@query(f"WITH {REF}, {CUR}, {_FREQ}, {_CHI} SELECT feature, round(statistic, 6) AS statistic, dof, {_CHI_SEV} AS severity, current_n FROM pv")
def chi2_by_feature(spark: SparkSession, sf: str) -> DataFrame:
    return _chi2(spark, sf).select("feature", F.round("statistic", 6).alias("statistic"), "dof", "severity", "current_n")


# Statistics of many shapes: customers per nation against all customers, per market segment.
_SEGMENTS = f"""base AS (SELECT c_nationkey, c_mktsegment, CAST(c_acctbal > 5000 AS INTEGER) AS rich, round(c_acctbal, -3) AS balance FROM customer),
lb AS (SELECT c_nationkey AS nation, 'c_mktsegment' AS feature, c_mktsegment AS value FROM base UNION ALL SELECT c_nationkey, 'rich', CAST(rich AS VARCHAR) FROM base),
freq AS (SELECT feature, value AS category, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS freq FROM lb GROUP BY 1, 2),
tot AS (SELECT nation, feature, count(*) AS current_n FROM lb GROUP BY 1, 2), obs AS (SELECT nation, feature, value AS category, count(*) AS o FROM lb GROUP BY 1, 2, 3),
chi AS (SELECT tot.nation, f.feature, sum((coalesce(o, 0) - freq * current_n) ** 2 / (freq * current_n)) AS statistic,
  CAST(greatest(count(*) - 1, 1) AS INTEGER) AS dof, sum(freq) AS mass, max(current_n) AS current_n
  FROM freq f JOIN tot USING (feature) LEFT JOIN obs ON obs.feature = f.feature AND obs.category = f.category AND obs.nation = tot.nation GROUP BY 1, 2), {_GAMMA.format(k='nation, ')}"""


@query(f"WITH {_SEGMENTS} SELECT nation, feature, round(statistic, 6) AS statistic, dof, round(p_value, 6) AS p_value, {_CHI_SEV} AS severity FROM pv")
def chi2_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), "c_mktsegment", (F.col("c_acctbal") > 5000).cast("int").alias("rich")
    )
    features = ["c_mktsegment", "rich"]
    out = D.chi2(P.categorical_profile(rows, features), rows, features, ["nation"])
    return out.select("nation", "feature", F.round("statistic", 6).alias("statistic"), "dof", F.round("p_value", 6).alias("p_value"), "severity")


_OUT = """o AS (SELECT (SELECT avg(label) FROM ref) AS r, avg(label) AS c, count(*) AS current_n FROM cur),
outp AS (SELECT *, ((1 - c + 1e-8) - (1 - r + 1e-8)) * ln((1 - c + 1e-8) / (1 - r + 1e-8)) + ((c + 1e-8) - (r + 1e-8)) * ln((c + 1e-8) / (r + 1e-8)) AS psi FROM o)"""


@query(f"WITH {REF}, {CUR}, {_OUT} SELECT round(psi, 6) AS psi, {_SEV} AS severity, round(r, 9) AS reference_class_1_rate, round(c, 9) AS current_class_1_rate, current_n FROM outp")
def output_psi(spark: SparkSession, sf: str) -> DataFrame:
    out = D.output_drift(P.class_proportions(reference(spark, sf), F.col("label")), current(spark, sf), F.col("label"))
    return out.withColumns({c: F.round(c, 9) for c in ("reference_class_1_rate", "current_class_1_rate")}).withColumn("psi", F.round("psi", 6))


@query(f"""WITH {REF}, {CUR}, o AS (SELECT CAST(floor((SELECT avg(label) FROM ref) * 100) AS INTEGER) AS m, count(*) AS n FROM cur),
b AS (SELECT 0 / (100 + m + 1e-8) + 1e-8 AS r0, (100 + m) / (100 + m + 1e-8) + 1e-8 AS r1, 0 / (n + 1e-8) + 1e-8 AS c0, n / (n + 1e-8) + 1e-8 AS c1, n FROM o)
SELECT round((c0 - r0) * ln(c0 / r0) + (c1 - r1) * ln(c1 / r1), 6) AS psi, 'low' AS severity, n AS current_n FROM b""")
def output_psi_compat(spark: SparkSession, sf: str) -> DataFrame:
    out = D.output_drift(P.class_proportions(reference(spark, sf), F.col("label")), current(spark, sf), F.col("label"), mode="compat")
    return out.select(F.abs(F.round("psi", 6)).alias("psi"), "severity", "current_n")


_ALL = f"{_PSI_ALL}, {_FREQ}, {_CHI}, {_OUT}"
_ROWS = f"""m AS (SELECT feature, 'psi' AS metric, psi AS value, CAST(NULL AS DOUBLE) AS p_value, {_SEV} AS severity, 0 AS source FROM psi
  UNION ALL SELECT feature, 'chi2', statistic, p_value, {_CHI_SEV}, 1 FROM pv)"""
_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def _metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.metric_rows(_psi(spark, sf), _chi2(spark, sf))


@query(f"WITH {_ALL}, {_ROWS} SELECT feature, metric, round(value, 6) AS value, severity, source FROM m")
def metric_rows_union(spark: SparkSession, sf: str) -> DataFrame:
    return _metric_rows(spark, sf).withColumn("value", F.round("value", 6)).drop("p_value")


@query(f"""WITH {_ALL}, {_ROWS}, s AS (SELECT {_RANK} AS k FROM m UNION ALL SELECT {_RANK.replace('severity', _SEV)} FROM outp)
SELECT CASE max(k) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM s""")
def report_severity(spark: SparkSession, sf: str) -> DataFrame:
    out = D.output_drift(P.class_proportions(reference(spark, sf), F.col("label")), current(spark, sf), F.col("label"))
    return D.aggregate_severity(_metric_rows(spark, sf).select("severity").unionByName(out.select("severity")))


@query(f"""WITH {_ALL}, {_ROWS}, x AS (SELECT feature, metric, value, severity FROM m UNION ALL SELECT 'label', 'output', psi, {_SEV} FROM outp)
SELECT feature, metric, round(value, 6) AS value, severity, CASE max({_RANK}) OVER () WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS report_severity,
  (SELECT count(*) FROM cur) AS window_size FROM x""")
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    report = D.drift_report(_profile(spark, sf), current(spark, sf), NUMERIC, CATEGORICAL, F.col("label"))
    return D.exploded_report(report).drop("report_id").withColumn("value", F.round("value", 6))


# Per-segment reports: the same metrics for each ship year of the current side.
_K_LONG = f"lk AS ({long_sql('cur', NUMERIC, 'DOUBLE', 'segment')})"
_K_COUNTS = """kc AS (SELECT segment, lk.feature, b.bin, count(CASE WHEN value IS NOT NULL AND len(list_filter(e, lambda x: x <= value)) = b.bin THEN 1 END) AS n
  FROM lk JOIN edges USING (feature), (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)) b GROUP BY 1, 2, 3)"""
_K_PSI = """kpsi AS (SELECT segment, feature, sum((c - r) * ln(c / r)) AS psi FROM (
  SELECT c.segment, r.feature, r.n / (sum(r.n) OVER (PARTITION BY c.segment, r.feature) + 1e-8) + 1e-8 AS r, c.n / (sum(c.n) OVER (PARTITION BY c.segment, r.feature) + 1e-8) + 1e-8 AS c
  FROM rc r JOIN kc c ON r.feature = c.feature AND r.bin = c.bin) GROUP BY 1, 2)"""
_K_CHI = f"""cats AS ({long_sql('cur', CATEGORICAL, 'VARCHAR', 'segment')}),
tot AS (SELECT segment, feature, count(*) AS current_n FROM cats GROUP BY 1, 2), obs AS (SELECT segment, feature, value AS category, count(*) AS o FROM cats GROUP BY 1, 2, 3),
chi AS (SELECT tot.segment, f.feature, sum((coalesce(o, 0) - greatest(freq * current_n, 1e-8)) ** 2 / greatest(freq * current_n, 1e-8)) AS statistic,
  CAST(greatest(count(*) - 1, 1) AS INTEGER) AS dof, sum(freq) AS mass, max(current_n) AS current_n
  FROM freq f JOIN tot USING (feature) LEFT JOIN obs ON obs.feature = f.feature AND obs.category = f.category AND obs.segment = tot.segment GROUP BY 1, 2), {_GAMMA.format(k='segment, ')}"""
_K_OUT = _OUT.replace("o AS (SELECT", "o AS (SELECT segment,", 1).replace("FROM cur)", "FROM cur GROUP BY 1)", 1)
_K_ROWS = f"""x AS (SELECT segment, feature, 'psi' AS metric, psi AS value, {_SEV} AS severity FROM kpsi
  UNION ALL SELECT segment, feature, 'chi2', statistic, {_CHI_SEV} FROM pv UNION ALL SELECT segment, 'label', 'output', psi, {_SEV} FROM outp)"""


@query(f"""WITH {REF}, {CUR}, {_LONG_REF}, {_EDGES}, {_REF_COUNTS}, {_K_LONG}, {_K_COUNTS}, {_K_PSI}, {_FREQ}, {_K_CHI}, {_K_OUT}, {_K_ROWS}
SELECT segment, feature, metric, round(value, 6) AS value, severity, CASE max({_RANK}) OVER (PARTITION BY segment) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS report_severity FROM x""")
def drift_report_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    report = D.drift_report(_profile(spark, sf), current(spark, sf), NUMERIC, CATEGORICAL, F.col("label"), ["segment"])
    return D.exploded_report(report, ["segment"]).drop("report_id", "window_size").withColumn("value", F.round("value", 6))


# A fleet: rows of odd and even line numbers are two models, each compared with its own reference.
def _of_model(sql: str, model: int) -> str:
    for name in ("ref", "cur"):
        sql = sql.replace(f"{name} AS (", f"all_{name} AS (", 1)
    at = sql.index(_LONG_REF)
    pick = ", ".join(f"{n} AS (SELECT * FROM all_{n} WHERE l_linenumber % 2 = {model})" for n in ("ref", "cur"))
    return f"{sql[:at]}{pick}, {sql[at:]}"


def _fleet_sql(select: str) -> str:
    return " UNION ALL ".join(f"SELECT {m} AS model_version, * FROM (WITH {_of_model(_ALL, m)}, {_ROWS}, x AS (SELECT feature, metric, value, severity, source FROM m UNION ALL SELECT 'label', 'output', psi, {_SEV}, 2 FROM outp) {select})" for m in (0, 1))


def _fleet(spark: SparkSession, sf: str) -> DataFrame:
    key = (F.col("l_linenumber") % 2).alias("model_version")
    ref, cur = reference(spark, sf).select("*", key), current(spark, sf).select("*", key)
    profile = P.reference_profile(ref, NUMERIC, CATEGORICAL, F.col("label"), ["model_version"])
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    return D.drift_report(profile, cur, NUMERIC, CATEGORICAL, F.col("label"), ["model_version"], profile_keys=["model_version"], as_of=as_of)


@query(_fleet_sql("SELECT feature, metric, round(value, 6) AS value, severity, (SELECT count(*) FROM cur) AS window_size FROM x"))
def fleet_drift_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.exploded_report(_fleet(spark, sf), ["model_version"])
    return rows.select("model_version", "feature", "metric", F.round("value", 6).alias("value"), "severity", "window_size")


@query(f"""SELECT model_version, CASE max({_RANK}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, min(n) AS window_size,
  string_agg(CASE WHEN k <= 5 THEN feature || ':' || metric || ':' || severity END, ',' ORDER BY k) AS top, '' AS violations
FROM (SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY source = 2, {_RANK} DESC, value DESC, source, feature) AS k
  FROM ({_fleet_sql("SELECT *, (SELECT count(*) FROM cur) AS n FROM x")})) GROUP BY 1""")
def alert_event_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Every model's first report is a change; the events keep to their contract (versions count from 1 there)."""
    changes = _fleet(spark, sf).withColumns({"model_name": F.lit("m"), "previous_severity": F.lit(None).cast("string"), "model_version": F.col("model_version") + 1})
    checked = V.check(D.alert_events(changes), V.alert_event_rules())
    top = F.array_join(F.transform("top_features", lambda t: F.concat_ws(":", t["feature"], t["metric"], t["severity"])), ",")
    return checked.select((F.col("model_version") - 1).alias("model_version"), "severity", "window_size", top.alias("top"), F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {_ALL}, {_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, value DESC, source, feature) AS rank FROM m)
SELECT CAST(rank AS INTEGER) AS rank, feature, metric, round(value, 6) AS value, severity FROM r WHERE rank <= 5""")
def top_drifted_features(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_drifted_features(_metric_rows(spark, sf)).withColumn("value", F.round("value", 6))


@query(f"""WITH {_ALL}, {_ROWS}, r AS (SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, CASE metric WHEN 'psi' THEN value ELSE 1 - p_value END DESC, source, feature) AS rank FROM m)
SELECT CAST(rank AS INTEGER) AS rank, feature, CASE metric WHEN 'psi' THEN 'PSI' ELSE 'Chi-square' END AS type,
  CASE metric WHEN 'psi' THEN round(value, 4) ELSE round(p_value, 6) END AS value, severity FROM r WHERE rank <= 3""")
def top_features_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_features_dashboard(_metric_rows(spark, sf))


@query(f"""WITH {_PSI_ALL} SELECT CAST(row_number() OVER (ORDER BY psi DESC, feature) AS INTEGER) AS rank, feature, round(psi, 6) AS psi, {_SEV} AS severity FROM psi QUALIFY rank <= 5""")
def top5_psi(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_psi(_psi(spark, sf)).withColumn("psi", F.round("psi", 6))


@query(f"""WITH {REF}, {CUR}, {_FREQ}, {_CHI} SELECT CAST(row_number() OVER (ORDER BY p_value, feature) AS INTEGER) AS rank, feature, round(p_value, 6) AS p_value, {_CHI_SEV} AS severity FROM pv QUALIFY rank <= 5""")
def top5_chi2(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_chi2(_chi2(spark, sf)).withColumn("p_value", F.round("p_value", 6))
