"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its PREFIX nearest reference points (pivots), in order. Inverted lists per label and
pivot give the candidates: pairs that share SHARED pivots or more, counted by one product of incidence
matrices for each list. A pair is taken in the list of its smallest shared pivot only, then verified by its
cosine. Links are counted where they are found; no table of pairs is ever made.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import lookup, per_row, settle
from tideline.operators.graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 0.93
#: Nearest pivots that describe a vector, and how many of them a candidate pair shares.
PREFIX, SHARED = 8, 2
#: Rows of an inverted list that one task compares at once; longer lists are split by a second pivot, then in blocks.
LIST = 1024
#: Pivots: four for the square root of the largest label's rows, between these bounds, chosen among
#: SAMPLE rows for each pivot (so 8192 rows at most); two of them have a cosine below APART.
PIVOTS, SAMPLE, APART = (64, 4096), 2, 0.8
SEED = 42
#: Rows of an incidence product, and pairs verified at once.
ROWS, PAIRS = 256, 1 << 15


def units(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, unit vectors in double precision) of the usable vectors of a column, by length.

    Not usable: null, empty, zero, or with a null or non-finite component.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = values[starts[rows][:, None] + np.arange(size)].astype(np.float64)
        scale = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (scale > 0)
        x = x[good] / scale[good][:, None]
        yield size, rows[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(sample: dict[int, np.ndarray], many: int) -> dict[int, np.ndarray]:
    """For each length, sampled unit vectors that are apart from each other; what is missing is drawn at random."""
    found = {}
    for size, x in sample.items():
        taken, n = np.empty((many, size)), 0
        for v in x:
            if n < many and (not n or (taken[:n] @ v).max() < APART):
                taken[n], n = v, n + 1
        taken[n:] = drawn(size, many)[n:]
        found[size] = taken
    return found


def drawn(size: int, many: int) -> np.ndarray:
    x = np.random.default_rng(SEED + size).normal(size=(many, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _describe(pivots: dict[int, np.ndarray], many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near: list = [None] * batch.num_rows
            raw: list = [None] * batch.num_rows
            for size, rows, x in units(batch.column(2)):
                if size not in pivots:
                    pivots[size] = drawn(size, many)
                for at in range(0, len(rows), ROWS):
                    order = np.argsort(-(x[at : at + ROWS] @ pivots[size].T), axis=1, kind="stable")[:, :PREFIX]
                    for r, v, o in zip(rows[at : at + ROWS].tolist(), x[at : at + ROWS], order.tolist(), strict=True):
                        near[r], raw[r] = o, v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(near, pa.list_(pa.int32()))], ["id", "label", "unit", "near"])

    return run


def describe(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label string, unit, near): the index of all vectors; unit and near are null where nothing can link.

    ``near`` has the numbers of the nearest pivots, nearest first. A null label makes a vector unusable.
    """
    kinds = dict(vectors.dtypes)
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.when(F.col(f"`{label_col}`").isNotNull(), F.col(f"`{vec_col}`").cast("array<double>")).alias("vec"),
    )
    largest = rows.where("vec is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    many = int(min(PIVOTS[1], max(PIVOTS[0], 1 << int(np.ceil(np.log2(4 * max(1, largest) ** 0.5))))))
    draw = F.xxhash64("id", "vec", F.lit("pivot"))
    sampled = rows.where("vec is not null").orderBy(draw).limit(SAMPLE * many).select("vec").toArrow()
    parts: dict[int, list[np.ndarray]] = {}
    for chunk in sampled.column(0).chunks:
        for size, _, x in units(chunk):
            parts.setdefault(size, []).append(x)
    pivots = choose_pivots({size: np.concatenate(x) for size, x in parts.items()}, many)
    return per_row(rows, ["id", "label", "vec"], _describe(pivots, many), f"id {kinds[id_col]}, label string, unit binary, near array<int>")


def _candidates(near: np.ndarray, p: int, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, later row) of a list that share SHARED pivots and have their smallest shared ones here."""
    known, at = np.unique(near, return_inverse=True)
    has = np.zeros((len(near), len(known)), dtype=np.float32)
    has[np.arange(len(near))[:, None], at.reshape(near.shape)] = 1
    other = has[:, (known < p) | (known > p) & (known < q)]
    for s in range(0, len(near), ROWS):
        found = has[s : s + ROWS] @ has[s:].T >= SHARED
        if other.shape[1]:
            found &= other[s : s + ROWS] @ other[s:].T == 0
        a, b = np.nonzero(np.triu(found, 1))
        yield a + s, b + s


def _compare(least: float):
    """Sorted lists in; for each member the rows that it links with, and links that join all of them, out."""

    def links(rows: list[tuple]) -> Iterator[tuple[bytes, bytes | None, int]]:
        _, _, p, q, i, j = rows[0][:6]
        x = np.frombuffer(b"".join([r[9] for r in rows])).reshape(len(rows), -1)
        near = np.array([r[10] for r in rows], dtype=np.int32)
        side, copies = np.array([r[6] for r in rows]), np.array([r[8] for r in rows], dtype=np.int64)
        ids, total, root = [r[7] for r in rows], np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for a, b in _candidates(near, p, q):
            if i != j:
                a, b = a[side[a] != side[b]], b[side[a] != side[b]]
            for at in range(0, len(a), PAIRS):
                c, d = a[at : at + PAIRS], b[at : at + PAIRS]
                close = np.einsum("ij,ij->i", x[c], x[d]) >= least
                c, d = c[close], d[close]
                np.add.at(total, c, copies[d])
                np.add.at(total, d, copies[c])
                while len(c := c[apart := root[c] != root[d]]):
                    d = d[apart]
                    yield ids[c[0]], ids[d[0]], 0
                    root[root == root[d[0]]] = root[c[0]]
        for k in np.flatnonzero(total).tolist():
            yield ids[k], None, int(total[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for _, group in groupby(rows, key=lambda r: r[:6]):
            out = list(links(list(group)))
            if out:
                a, b, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def _lists(posts: DataFrame) -> DataFrame:
    """Adds the length m of a posting's list (label, p, q)."""
    keyed = posts.withColumn("key", F.struct("label", "p", "q"))
    sizes = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).withColumn("w", F.col("m")), "lists")
    return lookup(keyed, sizes, "key", "w").where("m > 1").drop("key")


def compared(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, n) over different vectors (rid, label, unit, near, copies): links that join what is near (n = 0), and
    for each vector, b null, how many rows it links with in one list.

    A list above LIST rows is split by the second smallest shared pivot; where that is not enough, as in a large
    group of near copies, into blocks, and each pair of blocks is a task's work.
    """
    posts = reps.select("rid", "label", "near", F.explode("near").alias("p"), F.lit(-1).alias("q"))
    first = settle(_lists(posts), "postings")
    whole = [F.lit(0).alias(c) for c in ("i", "j", "side")]
    work = first.where(F.col("m") <= LIST).select("label", "p", "q", *whole, "rid")
    large = first.where(F.col("m") > LIST).drop("m", "q")
    if not large.isEmpty():
        second = settle(_lists(large.select("*", F.explode(F.filter("near", lambda x: x > F.col("p"))).alias("q"))), "postings")
        blocks = F.ceil(2 * F.col("m") / LIST).cast("int")
        cut = second.where(F.col("m") > LIST).withColumn("side", F.pmod(F.xxhash64("rid"), blocks).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        work = work.unionByName(second.where(F.col("m") <= LIST).select("label", "p", "q", *whole, "rid"))
        work = work.unionByName(cut.select("label", "p", "q", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "rid"))
    key = [F.octet_length("unit").alias("size"), "label", "p", "q", "i", "j"]
    full = work.join(reps.drop("label"), "rid").select(*key, "side", "rid", "copies", "unit", "near")
    names = ["size", "label", "p", "q", "i", "j"]
    return full.repartition(*names).sortWithinPartitions(*names).mapInArrow(_compare(least), "a binary, b binary, n bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """(id, n_links, component, kept): one row per vector, linked at a cosine of ``least`` or more within its label.

    n_links counts the other rows that link with it directly; component is the smallest id reachable, the row
    itself included; kept says that it is the row's own id. Null labels, null, empty or zero vectors, and vectors
    with null or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors
    are compared once and counted as often as they stand. Rows without an id link too; a component of
    such rows alone has a null name. Repeated rows stay. An empty table gives an empty one.
    """
    rows = settle(describe(vectors, id_col, vec_col, label_col).withColumn("rid", F.unhex(F.md5(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("unit"))))), "vectors")
    usable = rows.where("unit is not null")
    reps = usable.groupBy("rid").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("unit").alias("unit"), F.first("near").alias("near"),
    )
    reps = settle(reps, "distinct")
    found = settle(compared(reps.drop("first"), least), "links")
    totals = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b").distinct()).withColumnRenamed("node", "rid")
    rooted = reps.select("rid", "first", "copies").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")).join(totals, "rid", "left")
    rooted = settle(rooted.withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("copies") - 1), "rooted")
    names = settle(rooted.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("w")), "names")
    named = settle(lookup(rooted.drop("first"), names, "root", "w").select("rid", "copies", "n_links", "component"), "named")
    linked = lookup(usable.select("id", "rid"), named, "rid", "copies").select("id", "n_links", "component")
    alone = rows.where("unit is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def oracle() -> str:
    """Every pair of a label by brute force, for tables without unusable vectors of odd kinds."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT b, root FROM reach JOIN links ON node = a),
roots AS (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots USING (vec_id)
"""
