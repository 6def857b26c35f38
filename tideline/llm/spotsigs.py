"""Document fingerprints by SpotSigs: chains of content words that follow common words.

The set of a text's chains is its fingerprint, written as the sorted hashes of the chains. Near copies are
found among partitions by set length: sets whose sizes are too far apart cannot be
similar, and within the reach of sizes only sets that share a chain of the pruned prefix are compared.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import pieces, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Common words of the four languages; a chain starts after each of them.
ANTECEDENTS = frozenset(
    "the of and to in is that for it with was by or as are be this from "
    "le la les de des du et un une est en que qui dans pour sur au par "
    "der die das und von zu den dem ist ein eine im mit auf nicht sich "
    "el los las y se del con una por lo su es no para al".split()
)
CHAIN = 3
SIMILARITY = 0.8
#: Ranges of ids for each shuffle partition, so that what hashes to one partition evens out.
PARTS = 4
#: Ids drawn for each range, to place its bounds.
DRAWN = 100
PIECE = 2 << 20

# Small letters, digits and other bytes stay, capitals become small, the rest of ASCII is white space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
STARTS = frozenset(w.encode() for w in ANTECEDENTS)


def chains(text: str | None) -> set[int]:
    """Hashes of the chains of a text.

    A chain is the next ``CHAIN`` content words after a common word, joined with it; at the end it is
    shorter. In a text without common words every word starts a chain. No words give no chain.
    """
    from xxhash import xxh32_intdigest

    words = (text or "").encode("utf-8", "replace").translate(NORMAL).split()
    common = list(map(STARTS.__contains__, words))
    content = [w for w, c in zip(words, common, strict=True) if not c]
    if not content:
        return {xxh32_intdigest(b" ".join(words[i : i + CHAIN + 1])) for i in range(len(words))}
    if not any(common):
        return {xxh32_intdigest(b" ".join(words[i : i + CHAIN])) for i in range(max(1, len(words) - CHAIN + 1))}
    tails = list(map(b" ".join, zip(*[content[k:] for k in range(CHAIN)], strict=False)))
    tails += [b" ".join(content[k:]) for k in range(len(tails), len(content))]
    out, at = set(), 0
    for word, is_common in zip(words, common, strict=True):
        if not is_common:
            at += 1
        elif at < len(tails):
            out.add(xxh32_intdigest(word + b" " + tails[at]))
    return out or {xxh32_intdigest(b" ".join(words))}


def written(found: set[int]) -> str:
    return "".join([f"{h:08x}" for h in sorted(found)])


def jaccard(a: set[int], b: set[int], least: float = 0.0) -> float:
    """Share of common chains; 0 where the sizes alone keep it below ``least``. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    common = len(a & b)
    return common / (small + large - common)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first half as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, place) in; each row but the borrowed ones against its successor out."""
    from hashlib import sha256

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before: tuple | None = None  # part, id, text, chains, borrowed
    for batch in batches:
        for piece in pieces(batch, 3, PIECE):
            rows, kept = [], []
            for k, (part, borrowed, text) in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                text = text or ""
                found = chains(text)
                if before is not None and before[0] == part and not before[4]:
                    _, id_, old, sigs, _ = before
                    new = edited(old, text)
                    changed = chains(new)
                    kept.append(id_)
                    rows.append((len(old), sha256(new.encode("utf-8", "replace")).hexdigest(), written(sigs), written(changed), jaccard(sigs, changed), jaccard(sigs, found)))
                before = (part, piece.column(2).slice(k, 1), text, found, borrowed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(kept), *[pa.array(x) for x in zip(*rows, strict=True)]], names)


def _part(bounds: list, at: Column) -> Column:
    """Number of bounds that are not above the id, looked up in two levels; a null id comes first."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda b: b <= at))
    inside = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block - 1), lambda b: b <= at))
    return F.when(at.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * width + inside)


def _bounds(rows: DataFrame, parts: int, n: int) -> list:
    """At most ``parts`` - 1 ids, in order, that cut the rows evenly: of about DRAWN ids for each part, drawn by hash."""
    limit = min(1 << 24, DRAWN * parts * (1 << 24) // max(1, n) + 1)
    drawn = rows.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id", F.lit("part")), F.lit(1 << 24)) < limit)).select("id").distinct()
    ids = sorted(r["id"] for r in drawn.collect())
    return sorted({ids[k * len(ids) // parts] for k in range(1, parts)}) if ids else []


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each whole text, of the text edited with its successor, and their likeness.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The successor is the
    next row in order of id, then text; rows without an id come first, null texts are empty, and after the
    last row comes the first (a single row is its own successor). The order is cut into ranges of ids;
    each range borrows the first rows of the next one, and the last range those of the first.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    parts = parts or PARTS * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.count(F.when(F.col("id").isNull(), 1)).alias("no_id")).first()
    # Bounds are ids that exist, so no range is empty; the least id opens the first range by itself.
    bounds = [b for b in _bounds(rows, parts, row["n"]) if row["no_id"] or b != row["first"]]
    last = len(bounds)
    own = rows.withColumn("part", _part(bounds, F.col("id")))
    first_row = F.col("id").isNull() if row["no_id"] else F.col("id") == F.lit(row["first"])
    opens = F.col("id").isin(bounds) if bounds else F.lit(False)
    loans = F.array_compact(F.array(F.when(opens, F.col("part") - 1), F.when(first_row, F.lit(last))))
    lent = own.where(opens | first_row).withColumn("part", F.explode(loans))
    # Of several rows with a lent id only the first in order is a successor; the others stay unused.
    lent = lent.groupBy("part", "id").agg(F.min(F.struct(F.col("text").isNotNull().alias("has"), "text")).alias("x"))
    both = own.select("part", F.lit(False).alias("borrowed"), "id", "text").unionByName(lent.select("part", F.lit(True).alias("borrowed"), "id", F.col("x.text").alias("text")))
    ordered = both.repartition("part").sortWithinPartitions("part", "borrowed", "id", "text")
    out = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compare, out)


def _add_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, 1, PIECE):
            found = [sorted(chains(t)) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "chains"])


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members (id, set_id), pairs (a, b, similarity)): all pairs of different chain sets of at least ``least``.

    Equal sets are one class. Classes are partitioned by length; a set is posted to its own partition and
    asks its own and the next longer one, as lengths beyond ``1 / least`` times its own cannot reach
    it. Two sets that do share one of the rarest ``size - ceil(least * size) + 1`` chains of both; only
    such pairs are compared. A class without chains is alike to none.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_add_chains, f"id {kind}, chains array<bigint>")
    members = settle(rows.withColumn("set_id", F.hex(F.md5(F.to_json("chains")))), "chains")
    sets = members.select("set_id", "chains", F.size("chains").alias("size")).where("size > 0").dropDuplicates(["set_id"])
    each = settle(sets.select("set_id", "size", F.explode("chains").alias("chain")), "postings")
    # Rare chains first: a prefix of them meets few others. Only the order depends on the counts.
    order = W.partitionBy("set_id").orderBy("n", "chain")
    ranked = each.join(each.groupBy("chain").agg(F.count(F.lit(1)).alias("n")), "chain").withColumn("place", F.row_number().over(order))
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1)
    by_length = F.floor(F.log("size") / F.log(F.lit(1 / least)) + 1e-9)
    posted = settle(prefix.select("set_id", "size", "chain", by_length.alias("part")), "prefix")
    asked = posted.select(F.col("set_id").alias("a"), F.col("size").alias("size_a"), "chain", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    told = posted.select(F.col("set_id").alias("b"), F.col("size").alias("size_b"), "chain", "part")
    near = asked.join(told, ["chain", "part"]).where((F.col("size_a") < F.col("size_b")) | (F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    found = settle(near.where(F.col("size_a") >= F.lit(least) * F.col("size_b") - 1e-9).select("a", "b", "size_a", "size_b").distinct(), "candidates")
    left = sets.select(F.col("set_id").alias("a"), F.col("chains").alias("chains_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("chains").alias("chains_b"))
    common = F.size(F.array_intersect("chains_a", "chains_b"))
    measured = found.join(left, "a").join(right, "b").withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")))
    return members.select("id", "set_id"), measured.where(F.col("similarity") >= least - 1e-9).select("a", "b", "similarity")
