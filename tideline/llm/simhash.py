"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within the radius r are found without a miss: give every bit position i a nonzero vector
m(i) of r + 1 bits. Table v, for each nonzero v of r + 1 bits, keeps the positions with odd <m(i), v>.
At most r differing positions leave some v orthogonal to all their vectors; table v masks
them all out, and the two fingerprints have one key there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, lookup, per_row, pieces, settle
from tideline.operators.graph import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 3
SEED = 42
RADIUS = 3
#: A bucket up to this size is compared in one task; larger ones are hashed again at the next level.
BUCKET = 512
PIECE = 2 << 20


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """The masks of all tables; each level deals the vectors to the positions in another way."""
    width = radius + 1
    vectors = np.random.default_rng(SEED + level).permutation(np.arange(64) % ((1 << width) - 1) + 1)
    masks = []
    for v in range(1, 1 << width):
        mask = sum(1 << i for i, m in enumerate(vectors) if (int(m) & v).bit_count() & 1)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _fingerprints(texts: list[bytes | None]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    starts, rows = [], []
    for i, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        rows.append(i)
        starts.append(len(hashes))
        if len(words) < SHINGLE:
            hashes.append(xxh64_intdigest(b" ".join(words), SEED))
        else:
            runs = zip(*[words[k:] for k in range(SHINGLE)], strict=False)
            hashes.extend([xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)])
    if not rows:
        return out
    h = np.array(hashes, dtype=np.uint64)
    counts = np.zeros((len(rows), 64), dtype=np.int64)
    ends = [*starts[1:], len(h)]
    for k, (s, e) in enumerate(zip(starts, ends, strict=True)):
        for at in range(s, e, 1 << 16):
            bits = np.unpackbits(h[at : min(e, at + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[k] += bits.sum(axis=0, dtype=np.int64)
    sizes = np.array(ends) - np.array(starts)
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _add_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, PIECE):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else None for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_fingerprints(texts).view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the SimHash of every whole text.

    Words are runs between ASCII white space, A-Z in lower case; features are runs of three words with
    repeats, the whole sequence where there are fewer. A text that is null or has no word gets 0.
    """
    kind = dict(docs.dtypes)[id_col]
    return per_row(docs, [id_col, text_col], _add_fingerprint, f"id {kind}, fp bigint")


def _compare(radius: int, limit: int):
    """Sorted buckets in, links and the members of buckets that are too large out."""

    def links(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        values = fps.view(np.uint64)
        up = list(range(len(fps)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i in range(1, len(fps)):
            for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= radius):
                a, b = root(i), root(int(j))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    yield int(fps[i]), int(fps[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, large = None, [], False
        for batch in batches:
            out: list[tuple[int, int, int | None]] = []
            for key, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != bucket:
                    if len(held) > 1:
                        out += [(a, b, None) for a, b in links(np.array(held, dtype=np.int64))]
                    bucket, held, large = key, [], False
                if large:
                    out.append((fp, fp, key))
                    continue
                held.append(fp)
                if len(held) > limit:
                    out += [(x, x, key) for x in held]
                    held, large = [], True
            if out:
                a, b, key = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], ["a", "b", "bucket"])
        if len(held) > 1 and (rest := list(links(np.array(held, dtype=np.int64)))):
            a, b = zip(*rest, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "bucket"])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, one row each) within the radius.

    Within a bucket only links that join two parts are given, so their number stays below the number
    of members; what is reachable from what is the same as with all links. A bucket above the
    limit, told apart by nothing so far, is hashed again by masks dealt in another way, and so on:
    no pair is given up, and after a few levels its members differ in a few positions only.
    Two buckets whose 64-bit names clash are compared as one.
    """
    found = []
    rows, level = fps.select("fp", F.lit(0).cast("long").alias("bucket")), 0
    while True:
        masks = covering_masks(radius, level)
        tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in enumerate(masks)]))
        keyed = rows.select("fp", "bucket", tables.alias("x")).select(
            F.xxhash64("bucket", F.lit(level), "x.t", F.col("fp").bitwiseAND(F.col("x.mask"))).alias("bucket"), "fp")
        sorted_buckets = keyed.repartition("bucket").sortWithinPartitions("bucket", "fp")
        out = settle(sorted_buckets.mapInArrow(_compare(radius, max(bucket, 1 << min(30, 2 * level))), "a bigint, b bigint, bucket bigint"), "simhash")
        found.append(out.where("bucket is null").select("a", "b"))
        rows = out.where("bucket is not null").select(F.col("a").alias("fp"), "bucket")
        if rows.isEmpty():
            break
        level += 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component): the smallest id that is reachable over fingerprints within ``radius`` bits.

    Copies collapse to one fingerprint before anything is compared. Rows without an id take part, and
    a component of such rows alone has a null name; repeated rows stay. An empty table gives an empty one.
    """
    rows = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = settle(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    roots = components(near_links(groups.select("fp"), radius, bucket))
    rooted = settle(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    sizes = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("m"))
    named = lookup(rooted.select("fp", "n", "root"), settle(sizes, "sizes"), "root", "m").select("fp", "n", "component")
    return lookup(rows, settle(named, "named"), "fp", "n").select("id", "fp", "component")


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays: the row with the smallest id (ties: by content).

    Near copies are what :func:`near_duplicates` links: fingerprints over runs of SHINGLE words that differ in RADIUS
    bits or fewer. Texts without a word have the fingerprint zero. A row without an id comes after all
    with one. All columns are returned as they came; repeated rows become one, an empty table stays empty.
    """
    key = fresh(docs, "__row")
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not dict(docs.dtypes)[c].startswith("map")])
    named = docs.select("*", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), rest.alias("h")).alias(key))
    kept = near_duplicates(named, key).select(F.col("component").alias(key)).distinct()
    return named.join(kept, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
