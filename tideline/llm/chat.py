"""Cumulative snapshots of conversations: keep the maximal ones, then render them.

A log that grows with a conversation holds it many times, each time a turn longer. The state after a turn is
a rolling hash of all turns so far: the sum of hashes of (position, turn), so that it can be rolled
in parts. A conversation whose last state is an earlier state of a longer one is a snapshot of that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import settle

#: Turn numbers that are put in order in one sort, and turns that are rendered in one row.
CHUNK = 64
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame, keep_text: bool) -> DataFrame:
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws("\x00", role, text)).alias("turn_hash")
    return conversations.select("conv_id", "turn", digest, *([role.alias("role"), text.alias("text")] if keep_text else []))


def states(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_hash, pos, a, b): position of every turn and the rolling hash after it.

    Turns are in order of number (null first), then content; repeated rows count once. Long conversations
    are rolled in chunks of turn numbers, and totals of the chunks carry over.
    """
    turns = _turns(conversations, False).distinct().withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    turns = settle(turns, "turns")
    inside = W.partitionBy("conv_id", "chunk").orderBy("turn", "turn_hash")
    carried = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    same = lambda x, y: F.col(f"{x}.conv_id").eqNullSafe(F.col(f"{y}.conv_id")) & (F.col(f"{x}.chunk") == F.col(f"{y}.chunk"))
    counts = turns.groupBy("conv_id", "chunk").count().withColumn("before", F.coalesce(F.sum("count").over(carried), F.lit(0)))
    numbered = turns.alias("t").join(counts.alias("c"), same("t", "c")).select("t.*", "before").withColumn("pos", F.col("before") + F.row_number().over(inside))
    wide = lambda *xs: F.xxhash64(*xs).cast("decimal(38,0)")
    hashed = settle(numbered.select("conv_id", "chunk", "turn", "turn_hash", "pos", wide("pos", "turn_hash").alias("x"), wide("turn_hash", "pos", F.lit("b")).alias("y")), "positions")
    sums = hashed.groupBy("conv_id", "chunk").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    sums = sums.select("conv_id", "chunk", *[F.coalesce(F.sum(c).over(carried), F.lit(0)).alias(c) for c in ("sx", "sy")])
    rolled = W.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    joined = hashed.alias("t").join(sums.alias("c"), same("t", "c")).select("t.*", "sx", "sy")
    total = lambda part, before: (F.sum(part).over(rolled) + F.col(before)).cast("decimal(38,0)")
    return joined.select("conv_id", "turn", "turn_hash", "pos", total("x", "sx").alias("a"), total("y", "sy").alias("b"))


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): the smallest id of each content that no longer conversation begins with.

    States are counted before they meet, so a first turn that a third of all logs share is one row.
    A state that more conversations pass through than end in belongs to a longer one.
    """
    last = rolled.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    same = F.col("l.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("l.pos") == F.col("s.pos"))
    ends = rolled.alias("s").join(last.alias("l"), same, "left_semi")
    classes = settle(ends.groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal")), "classes")
    through = rolled.groupBy("pos", "a", "b").agg(F.count(F.lit(1)).alias("n_through"))
    longer = through.join(classes.select("pos", "a", "b", "n_equal"), ["pos", "a", "b"]).where(F.col("n_through") > F.col("n_equal")).select("pos", "a", "b")
    kept = classes.join(longer, ["pos", "a", "b"], "left_anti")
    return kept.select("conv_id", F.col("pos").alias("n_turns"), "n_equal")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, segment, text): maximal conversations, rendered.

    A conversation of more than ``CHUNK`` turns is rendered in segments of that many. Rows without an id form one
    conversation; a null role reads ``unknown``, a null text is empty. Conversations that are equal in
    roles, texts and order are one, with the smallest id (null only if all of them have none).
    """
    rolled = settle(states(conversations), "states")
    kept = settle(maximal(rolled), "maximal")
    of_kept = lambda x: F.col(f"{x}.conv_id").eqNullSafe(F.col("k.conv_id"))
    places = rolled.alias("r").join(kept.alias("k"), of_kept("r")).select("r.conv_id", "r.turn", "r.turn_hash", "pos", "n_turns", "n_equal")
    texts = _turns(conversations, True).alias("t").join(kept.alias("k"), of_kept("t"), "left_semi")
    same = F.col("t.conv_id").eqNullSafe(F.col("p.conv_id")) & F.col("t.turn").eqNullSafe(F.col("p.turn")) & (F.col("t.turn_hash") == F.col("p.turn_hash"))
    rows = texts.alias("t").join(places.alias("p"), same).select("p.conv_id", "n_turns", "n_equal", F.floor((F.col("pos") - 1) / CHUNK).alias("segment"), F.struct("pos", "role", "text").alias("turn"))
    each = rows.groupBy("conv_id", "n_turns", "n_equal", "segment").agg(F.array_sort(F.collect_set("turn")).alias("turns"))
    return each.select("conv_id", "n_turns", "n_equal", "segment", rendered(F.col("turns")).alias("text"))


def oracle() -> str:
    """DuckDB SQL for ``collapse(conversations)``, on lists of turns in place of hashes."""
    return f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text)) AS pos FROM turns),
lists AS (SELECT conv_id, list(role || chr(0) || text ORDER BY pos) AS l FROM numbered GROUP BY conv_id),
classes AS (SELECT l, min(conv_id) AS conv_id, CAST(count(*) AS BIGINT) AS n_equal FROM lists GROUP BY l),
prefixes AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM classes)),
kept AS (SELECT * FROM classes ANTI JOIN prefixes USING (l))
SELECT n.conv_id, CAST(len(k.l) AS BIGINT) AS n_turns, k.n_equal, CAST((pos - 1) // {CHUNK} AS BIGINT) AS segment,
       string_agg('{OPEN}' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM numbered n JOIN kept k ON n.conv_id = k.conv_id GROUP BY ALL
"""
