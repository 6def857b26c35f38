"""Mixing of sources to target weights by Pfair scheduling.

Documents of a source form blocks. With q of T slots for a source, its k-th block (from 0) is released at
floor(k T / q) and due at ceil((k + 1) T / q). Earliest deadline first meets all of these, so at any
time each source has had less than one block more or less than its share. q and T are whole numbers in
exactly the ratio of the weights. The schedule is worked out once, for T slots (then it repeats) or until
a source ends; every block finds its slot by itself.
"""

from __future__ import annotations

import heapq
import math
import sys
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import fresh, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 8
#: Without given weights, a source weighs as its number of documents to this power.
TEMPERATURE = 0.7
#: Rows of a source that are ranked in one sort.
RANKED = 10_000
STATE = "struct<block: bigint, place: bigint, phase: bigint, release: bigint, deadline: bigint, slot: bigint>"


def slot_counts(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the ratio of the weights, to the last bit of each float."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[x.denominator for x in exact.values()])
    whole = {s: int(x * unit) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: q // common for s, q in whole.items()}


def pattern(counts: dict[str, int], left: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots of each source by earliest deadline among released blocks: one period, or until a source has no block left."""
    period = sum(counts.values())
    ahead: list[tuple[int, str]] = []  # release of the next block of each source
    ready: list[tuple[int, str]] = [(-(-period // q), s) for s, q in counts.items()]
    heapq.heapify(ready)
    found = {s: array("q") for s in counts}
    for slot in count():
        while ahead and ahead[0][0] <= slot:
            _, s = heapq.heappop(ahead)
            heapq.heappush(ready, (-(-(len(found[s]) + 1) * period // counts[s]), s))
        s = heapq.heappop(ready)[1]
        found[s].append(slot)
        if slot + 1 == period or len(found[s]) == left[s]:
            return {s: np.array(x, dtype=np.int64) for s, x in found.items()}
        heapq.heappush(ahead, (len(found[s]) * period // counts[s], s))


def phases(counts: dict[str, int], blocks: dict[str, int]) -> dict[str, list[tuple[int, int, int, int, int, np.ndarray]]]:
    """source -> (first block, phase, first slot, slots per period, period, slots) of each phase.

    A phase ends when a source has no block left; the others go on with their shares of what remains.
    Sources without slots wait until all others are through, and then share evenly.
    """
    left, done, start, phase = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, 0
    out: dict[str, list] = {s: [] for s in blocks}
    while left:
        active = {s: counts[s] for s in left if counts.get(s)} or dict.fromkeys(left, 1)
        period, slots = sum(active.values()), pattern(active, left)
        ends = [(left[s] - 1) // q * period + int(slots[s][(left[s] - 1) % q]) for s, q in active.items() if (left[s] - 1) % q < len(slots[s])]
        length = min(ends) + 1  # in a pattern that stops early only the source that ended has its last block
        for s, q in active.items():
            out[s].append((done[s], phase, start, q, period, slots[s]))
            used = length // period * q + int(np.searchsorted(slots[s], length % period))
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start, phase = start + length, phase + 1
    return out


def _place(plan: dict, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {s: [p[0] for p in found] for s, found in plan.items()}
        for batch in batches:
            rows = []
            for source, rank in zip(batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True):
                number = (rank - 1) // block
                first, phase, start, q, period, slots = plan[source][bisect_right(firsts[source], number) - 1]
                k = number - first
                rows.append({
                    "block": number, "place": (rank - 1) % block, "phase": phase, "release": start + k * period // q,
                    "deadline": start - (-(k + 1) * period // q), "slot": start + k // q * period + int(slots[k % q]),
                })
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, type=batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    return run


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block: int = BLOCK, out: str = "mix",
) -> DataFrame:
    """Add a struct column: block of the source, place in the block, phase, release, deadline, slot.

    (slot, place) is the order of the mixture; each slot is one block and no slot is empty. Within a source
    documents come in an order that a hash of the id draws (ties: of the whole row; equal rows are
    interchangeable). Rows without a source are a source of their own, named the empty string; a
    source without a given weight follows after the others. Shares are exactly the weights.
    The driver and each task hold one number per source, and one per
    block for the slots worked out (8 bytes; none of a period that repeats).
    """
    source, h, part, rank = (fresh(docs, f"__{x}") for x in ("source", "hash", "part", "rank"))
    everything = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")])
    named = docs.withColumn(source, F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")))
    sizes = {r[source]: r["count"] for r in named.groupBy(source).count().collect()}
    if not sizes:
        return docs.withColumn(out, F.lit(None).cast(STATE))
    weights = weights if weights is not None else {s: n**TEMPERATURE for s, n in sizes.items()}
    counts = slot_counts({s: w for s, w in weights.items() if s in sizes and w > 0})
    plan = phases(counts, {s: -(-n // block) for s, n in sizes.items()})
    # Ranks: rows in ranges of the hash, so that a source of any size is sorted in parts.
    parts = F.element_at(F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, -(-n // RANKED))]), F.col(source))
    drawn = named.withColumn(h, F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), F.lit("mix")), 1)).withColumn(part, F.floor(F.col(h) / F.lit(2.0**63) * parts))
    before = drawn.groupBy(source, part).agg(F.count(F.lit(1)).alias(rank))
    before = settle(before.withColumn(rank, F.sum(rank).over(W.partitionBy(source).orderBy(part).rowsBetween(W.unboundedPreceding, -1))), "ranks")
    inside = drawn.withColumn("__n" + rank, F.row_number().over(W.partitionBy(source, part).orderBy(h, everything)))
    ranked = inside.join(before, [source, part], "left").withColumn(rank, F.coalesce(rank, F.lit(0)) + F.col("__n" + rank))
    work = ranked.select(*[F.col(f"`{c}`") for c in docs.columns], source, rank, F.lit(None).cast(STATE).alias(out))
    return work.mapInArrow(_place(plan, block), work.schema).drop(source, rank)


def stage(docs: DataFrame) -> DataFrame:
    """All documents in the order of the mixture, with their slot and place."""
    name, slot, place = fresh(docs, "__mix"), fresh(docs, "mix_slot"), fresh(docs, "mix_place")
    mixed = mix(docs, out=name).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{name}.slot").alias(slot), F.col(f"{name}.place").alias(place))
    return mixed.repartitionByRange(slot).sortWithinPartitions(slot, place)
