"""One query per operator with production parameters over its whole tables, and the SQL to check it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import alignment, chat, decontaminate, language, licenses, lines, mixing, phrases, pivots, repeats, secrets, simhash, spotsigs
from tideline.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(read(spark, sf_dir, "conversations"))


ORACLES["op1_chat"] = chat.oracle()


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], F.format_string("%.4f", m["coverage"]), m["start"], m["stop"]))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_matches"), F.array_join(shown, ",").alias("matches"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan_benchmark(docs, read(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("leak.spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    plain = [f"leak.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    return found.select("doc_id", *plain, F.array_join("leak.items", ",").alias("items"), spans.alias("spans"))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


ORACLES["op4_secrets"] = secrets.oracle()


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.with_next(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", *[f"mix.{c}" for c in ("block", "place", "phase", "release", "deadline", "slot")])


@query
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    numbers = F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed")
    out = lines.dedup_lines(docs, removed="removed")
    return out.select("doc_id", "text", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), numbers)


ORACLES["op9_lines"] = lines.oracle()


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), *[f"language.{c}" for c in ("lang_pred", "score", "second", "ambiguous")])


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op12_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivots.near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


ORACLES["op12_pivots"] = pivots.oracle()


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLES["op13_phrases"] = phrases.oracle()


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_decontaminate"] = f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item_words WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS run FROM places, lengths WHERE p + n - 1 <= len(w)),
hits AS (
  SELECT doc_id, p, runs.n, item FROM runs JOIN windows ON run = win AND runs.n = windows.n),
spans AS (
  SELECT doc_id, p AS start, max(p + n) AS stop FROM hits GROUP BY doc_id, p),
islands AS (
  SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start) AS k FROM (
    SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)),
merged AS (SELECT doc_id, k, min(start) AS start, max(stop) AS stop FROM islands GROUP BY doc_id, k),
per_doc AS (
  SELECT doc_id, sum(stop - start) AS n_hit, string_agg((start - 1) || ':' || (stop - 1), ',' ORDER BY start) AS spans FROM merged GROUP BY doc_id),
items AS (SELECT doc_id, list(DISTINCT item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(array_to_string(list_sort(items), ','), '') AS items, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN items USING (doc_id)
"""
