"""Line dedup by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, lookup, settle

#: A line on this many sites or more is boilerplate.
MIN_SITES = 5
#: Sketch size (log2 of registers) and the relative width of the band in which sites are counted exactly.
LOG_K, BAND = 10, 0.25
SALTS = 16


def line_key(line: Column) -> Column:
    """128 bits of the trimmed line, or null for a blank one. Runs of blanks count as one."""
    plain = F.trim(F.regexp_replace(line, r"[\x09-\x0D\x20]+", " "))
    return F.when(plain != "", F.unhex(F.md5(plain)))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(key, n_lines, n_sites): lines on at least ``min_sites`` distinct sites.

    ``lines`` has a key and a site per occurrence. Sketches of map partitions merge, so a line that stands
    on a third of all pages moves one sketch per task. An estimate within ``band`` of the threshold
    is replaced by an exact count; outside of it (eight standard errors and more) it decides, and
    n_sites is the rounded estimate.
    """
    sketched = lines.groupBy("key").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.count(F.lit(1)).alias("n_lines"))
    spread = settle(sketched.select("key", "n_lines", F.hll_sketch_estimate("sketch").alias("n_sites")).where(F.col("n_sites") >= min_sites * (1 - band)), "spread")
    near = spread.where(F.col("n_sites") <= min_sites * (1 + band)).select("key", "n_lines")
    seen = lines.join(near.select("key"), "key", "left_semi").select("key", "site").distinct()
    exact = near.join(seen.groupBy("key").agg(F.count(F.lit(1)).alias("n_sites")), "key").where(F.col("n_sites") >= min_sites)
    return spread.where(F.col("n_sites") > min_sites * (1 + band)).unionByName(exact.select("key", "n_lines", "n_sites"))


def removed_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """(row, removed array<int>): numbers of the lines that go, for rows that lose any.

    ``row`` is (null id?, id, hash of the text), as in ``row_of``. The first occurrence in order of row and line
    stays if ``keep_first``, so that no content is lost from all copies.
    """
    numbered = docs.select(row_of(docs).alias("row"), F.col(f"`{site_col}`").cast("string").alias("site"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n", -1)).alias("line", "content"))
    lines = settle(numbered.select("row", F.coalesce("site", F.lit("\x00")).alias("site"), "line", line_key(F.col("content")).alias("key")).where("key is not null"), "lines")
    common = settle(boilerplate(lines, min_sites), "boilerplate").select("key", F.col("n_lines").alias("n"), F.lit(True).alias("common"))
    hit = settle(lookup(lines.select("key", "row", "line"), common, "key", "n").where("common").drop("common"), "hits")
    if keep_first:
        salted = hit.groupBy("key", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")).agg(F.min(F.struct("row", "line")).alias("first"))
        firsts = salted.groupBy("key").agg(F.min("first").alias("first")).join(common, "key").select("key", "n", "first")
        hit = lookup(hit, settle(firsts, "firsts"), "key", "n").where(F.struct("row", "line") != F.col("first"))
    return hit.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def row_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a row; rows equal in id and text count as one and share their fate."""
    id_ = F.col(f"`{id_col}`")
    return F.struct(id_.isNull().alias("no_id"), id_.alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))


def dedup_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True, removed: str | None = None) -> DataFrame:
    """All rows and columns, with boilerplate lines cut from the text.

    A line is boilerplate if it stands on ``min_sites`` distinct values of ``site_col``; all rows without a site
    are one site. Lines are compared trimmed, with runs of blanks as one; blank lines and null texts stay.
    ``removed`` names a column for the numbers of the lines that went (null: none).
    """
    row, gone = fresh(docs, "__row"), removed or fresh(docs, "__gone")
    found = removed_lines(docs, text_col, site_col, min_sites, keep_first).select(F.col("row").alias(row), F.col("removed").alias(gone))
    joined = docs.withColumn(row, row_of(docs, text_col=text_col)).alias("d").join(found.alias("f"), F.col(f"d.{row}").eqNullSafe(F.col(f"f.{row}")), "left")
    kept = F.filter(F.split(F.col(f"d.`{text_col}`"), "\n", -1), lambda x, i: ~F.array_contains(F.col(f"f.{gone}"), i))
    text = F.when(F.col(f"f.{gone}").isNull(), F.col(f"d.`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.col(f"f.{gone}")] if removed else []))


def oracle(min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for the query over ``documents``, with exact counts throughout."""
    return f"""
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, i - 1 AS line, trim(regexp_replace(l[i], '[\\x09-\\x0D\\x20]+', ' ', 'g')) AS key
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM parts)),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {min_sites}),
gone AS (
  SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY key ORDER BY doc_id, line) AS k FROM lines SEMI JOIN common USING (key)) WHERE k > 1),
kept AS (SELECT doc_id, string_agg(l[i], chr(10) ORDER BY i) AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM parts) k
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = k.doc_id AND g.line = i - 1) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS numbers FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(numbers, '') AS removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
