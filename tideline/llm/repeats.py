"""Removal of long repeated byte strings by sorted suffixes that induce the order of the others.

A repeated string of SPAN bytes has the same sampled position in all its occurrences: the leftmost least
hash of GRAM bytes in it. Only the suffixes at sampled positions are sorted. Spark sorts them (runs on disk,
merged by priority queue), so a shard may be far larger than memory. The suffixes before a
sampled one are never sorted on their own: the order one byte further left follows from the
present order by one stable pass over the preceding byte, and the common prefix of neighbours from the
least common prefix between them, plus one. A string is repeated if a neighbour shares SPAN bytes.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import lookup, per_row, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN = 400
GRAM = 100
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Sampled suffixes that one induction takes at once; groups above it are counted window by window.
GROUP = 8192
#: A group of this many members in a sample of one document in SAMPLE is split over SALTS tasks.
SAMPLE, HOT_MEMBERS, SALTS = 16, 64, 64
#: Contexts of hot anchors that a task remembers; beyond it starts anew and shuffles a few more rows.
SEEN = 100_000
LOW = np.uint64((1 << 32) - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of every run of ``gram`` bytes, built by doubling."""
    unit = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    unit ^= unit >> np.uint32(15)
    total, covered, width, factor, rest = None, 0, 1, 0x01000193, gram
    while rest:
        if rest & 1:
            if total is None:
                total, covered = unit, width
            else:
                n = len(data) - covered - width + 1
                total, covered = total[:n] * np.uint32(factor) + unit[covered : covered + n], covered + width
        rest >>= 1
        if rest:
            n = len(data) - 2 * width + 1
            unit, factor, width = unit[:n] * np.uint32(factor) + unit[width : width + n], factor * factor & 0xFFFFFFFF, 2 * width
    total = (total ^ (total >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return total ^ (total >> np.uint32(13))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every window of ``width`` keys."""
    size, low = 1, keys
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(keys) - width + 1], low[width - size :]) if size < width else low


def _sampled(texts: list[bytes], span: int, gram: int) -> Iterator[tuple[int, int]]:
    """(row, position) of all sampled positions. Pieces overlap, so that each window is seen once."""
    row, at, last = 0, 0, -1
    while row < len(texts):
        parts: list[tuple[int, int, int, int]] = []  # row, offset in the text, offset in the piece, bytes
        data, held = [], 0
        while row < len(texts) and held < PIECE:
            size = min(len(texts[row]) - at, PIECE + span - 1)
            if size >= span:
                parts.append((row, at, held, size))
                data.append(texts[row][at : at + size])
                held += size
            at += size - span + 1
            if at + span > len(texts[row]) or size < span:
                row, at = row + 1, 0
        if not parts:
            continue
        hashes = _gram_hashes(np.frombuffer(b"".join(data), dtype=np.uint8), gram)
        keys = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
        picked = (_least(keys, span - gram + 1) & LOW).astype(np.int64)
        for r, offset, start, size in parts:
            places = picked[start : start + size - span + 1]
            first = offset - start
            for p in places[np.flatnonzero(np.diff(places, prepend=-1))].tolist():
                if offset == 0 or r != last_row or p + first > last:
                    yield r, p + first
                last = p + first
            last_row = r


def _sample_suffixes(span: int, gram: int, hot: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        seen: Counter[bytes] = Counter()  # contexts of hot anchors in this task
        task, more = TaskContext.get().partitionId() * 0x9E3779B1, 0
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(2)]
            rows, names, salts, contexts, places = [], [], [], [], []

            def out(batch=batch):
                take = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(salts, pa.int32()), pa.array(contexts, pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(places, pa.int64())],
                    ["anchor", "salt", "context", "id", "th", "at"],
                )

            for row, p in _sampled(texts, span, gram):
                text = texts[row]
                name = xxh3_64_intdigest(text[p : p + gram]) - (1 << 63)
                left = max(0, p - (span - gram))
                context = xxh3_128_digest(text[left : p + span], seed=p - left)
                rows.append(row)
                names.append(name)
                salt = 0
                if name in hot:
                    seen[context] += 1
                    # Two rows of a context in this task prove that it repeats; more need not meet them, nor each other.
                    more += 1
                    salt = context[0] % SALTS if seen[context] <= 2 else -1 - (task + more) % (1 << 31)
                    if len(seen) > SEEN:
                        seen.clear()
                salts.append(salt)
                contexts.append(context)
                places.append(p)
                if len(rows) >= 50_000:
                    yield out()
                    rows, names, salts, contexts, places = [], [], [], [], []
            yield out()

    return run


def _pair_up(hot: frozenset[int]):
    """Rows sorted by (anchor, salt, context) in; those that may hold repeated strings out.

    ``whole``: the context stands elsewhere too. ``first``: set on one row of each context of an anchor
    that has other contexts (of hot anchors always, as their contexts are spread over tasks).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = first = waiting = None
        n, company = 0, False
        out: list[tuple] = []

        def close() -> None:
            """The rows of a context have ended."""
            nonlocal waiting
            if first is not None and company:
                out.append((*first, n > 1, True))
            elif first is not None:
                waiting = (first, n > 1)  # until the anchor ends or has another context

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[1] < 0:
                    out.append((*row, True, False))
                elif row[:2] != group:
                    close()
                    if waiting and waiting[1]:
                        out.append((*waiting[0], True, False))
                    group, first, waiting, n, company = row[:2], row, None, 1, row[0] in hot
                elif row[2] != first[2]:
                    close()
                    if waiting:
                        out.append((*waiting[0], waiting[1], True))
                    first, waiting, n, company = row, None, 1, True
                else:
                    n += 1
                    out.append((*row, True, False))
            if len(out) > 10_000:
                yield _members(out)
                out.clear()
        close()
        if waiting and waiting[1]:
            out.append((*waiting[0], True, False))
        if out:
            yield _members(out)

    return run


def _members(rows: list[tuple]) -> pa.RecordBatch:
    anchor, _, context, ids, th, at, whole, first = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.binary(), None, pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((anchor, context, ids, th, at, whole, first), kinds, strict=True)], ["anchor", "context", "id", "th", "at", "whole", "first"])


def induce(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], span: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) shift to the left at which a suffix's SPAN bytes stand elsewhere in its group; -1: none.

    ``groups`` (ascending) and ``rights`` (ascending within) are sorted: the suffixes at shift 0.
    """
    m = len(groups)
    right = np.zeros((m, span), dtype=np.uint8)
    for i, r in enumerate(rights):
        right[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    left = np.full((reach, m), -1, dtype=np.int64)
    for i, x in enumerate(lefts):
        left[: len(x), i] = np.frombuffer(x, dtype=np.uint8)[::-1]
    sizes = np.array([len(r) for r in rights])
    common = np.zeros(m, dtype=np.int64)  # with the suffix before it in the present order
    differ = right[1:] != right[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), span)
    common[1:] = np.where(groups[1:] == groups[:-1], np.minimum(same, np.minimum(sizes[1:], sizes[:-1])), 0)
    order = np.arange(m)
    low, high = np.full(m, -1), np.full(m, -1)
    for shift in range(reach + 1):
        up = common >= span
        shared = up.copy()
        shared[:-1] |= up[1:]
        who = order[shared]
        high[who] = shift
        low[who] = np.where(low[who] < 0, shift, low[who])
        if shift == reach:
            break
        byte = left[shift][order]
        step = np.argsort(groups[order] * 257 + byte + 1, kind="stable")
        grouped, byte = groups[order][step], byte[step]
        alike = np.flatnonzero((grouped[1:] == grouped[:-1]) & (byte[1:] == byte[:-1]) & (byte[1:] >= 0)) + 1
        following = np.zeros(m, dtype=np.int64)
        following[alike] = 1 + _least_between(common, step[alike - 1], step[alike])
        order, common = order[step], np.minimum(following, span)
    return low, high


def _least_between(values: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """min(values[after + 1 .. upto]) for each pair, by a table of powers of two."""
    if not len(after):
        return after
    level = np.log2(upto - after).astype(np.int64)
    out, table = np.empty(len(after), dtype=values.dtype), values
    for k in range(int(level.max()) + 1):
        now = level == k
        out[now] = np.minimum(table[after[now] + 1], table[upto[now] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def _shared_shifts(span: int, gram: int, limit: int):
    """Rows (anchor, context, left, right, crowded) sorted by (anchor, right) in; shifts of repeated strings out.

    Members of a group that is crowded, or above ``limit``, are not kept: digests of their windows go on, of each window only
    from the leftmost place of the anchor in it. So a window is counted once for each place where it
    stands, even if the anchor's bytes stand in it several times.
    """
    reach = span - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = ["context", "low", "high", "windows"]
        held: list[tuple] = []  # whole groups, then the present one
        start, group, large = 0, None, False

        def spread(rows: list[tuple]) -> pa.RecordBatch:
            context, low, windows = [], [], []
            for anchor, name, left, right, _ in rows:
                text, first, seed = left + right, max(0, span - len(right)), anchor % (1 << 64)  # one place may be seen from several anchors
                before = text.rfind(right[:gram], 0, len(left) + gram - 1)  # windows from there on to the left are that place's
                last = len(left) - before - 1
                if last < first:
                    continue
                context.append(name)
                low.append(first)
                windows.append(b"".join(xxh3_128_digest(text[len(left) - s : len(left) - s + span], seed=seed) for s in range(first, last + 1)))
            return pa.RecordBatch.from_arrays([pa.array(context, pa.binary()), pa.array(low, pa.int32()), pa.array([None] * len(low), pa.int32()), pa.array(windows, pa.binary())], names)

        def settle_groups(rows: list[tuple]) -> pa.RecordBatch:
            anchors = np.unique([r[0] for r in rows], return_inverse=True)[1]
            low, high = induce(anchors, [r[2] for r in rows], [r[3] for r in rows], span, reach)
            hit = np.flatnonzero(low >= 0)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in hit], pa.binary()), pa.array(low[hit], pa.int32()), pa.array(high[hit], pa.int32()), pa.nulls(len(hit), pa.binary())], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                far: list[tuple] = []
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 1024).columns], strict=True):
                    if row[0] != group:
                        group, start, large = row[0], len(held), row[4]
                        if start >= limit:
                            yield settle_groups(held)
                            held, start = [], 0
                    if large:
                        far.append(row)
                        continue
                    held.append(row)
                    if len(held) - start > limit:
                        far += held[start:]
                        del held[start:]
                        large = True
                if far:
                    yield spread(far)
        if held:
            yield settle_groups(held)

    return run


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs: list[list[int]] = []
                for s in sorted((s["low"], s["high"]) for s in spans or []):
                    low, high = max(0, s[0]), min(len(data), s[1])
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                kept, at = sha256(), 0
                for low, high in runs:
                    kept.update(data[at:low])
                    at = high
                kept.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
            n, removed, count, digest, runs = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def _is(id_: str, th: str) -> Column:
    return F.col("id").eqNullSafe(F.col(id_)) & (F.col("th") == F.col(th))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans): what is left without repeated strings.

    A byte goes if a string of ``span`` bytes over it starts anywhere else too, in this document or in
    another; no string crosses documents, and all is judged on the input. A null text is empty; rows
    without an id take part; each of several equal rows counts, so they lose all that is longer than ``span``.

    Contexts that stand elsewhere as a whole settle their copies at once. Only one of each
    differing context of an anchor is fetched and enters the induction.
    """
    kind, reach = dict(docs.dtypes)[id_col], span - gram
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))
    long = rows.where(F.octet_length("text") >= span)
    shape = f"anchor bigint, salt int, context binary, id {kind}, th bigint, at bigint"

    sampled = long.where(F.pmod(F.xxhash64("id", "th"), F.lit(SAMPLE)) == 0).mapInArrow(_sample_suffixes(span, gram, frozenset()), shape)
    counted = settle(sampled.groupBy("anchor").count(), "anchors")
    total = counted.agg(F.sum("count")).first()[0] or 0
    hot = frozenset(r["anchor"] for r in counted.where(F.col("count") >= max(HOT_MEMBERS, total // 1000)).collect())  # a thousand at most

    suffixes = long.mapInArrow(_sample_suffixes(span, gram, hot), shape)
    by_context = suffixes.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "context")
    members = settle(by_context.mapInArrow(_pair_up(hot), f"anchor bigint, context binary, id {kind}, th bigint, at bigint, whole boolean, first boolean"), "members")

    wanted = members.where("first").select("anchor", "context", F.col("id").alias("of"), F.col("th").alias("of_th"), F.col("at").cast("int").alias("at"))
    data, start = F.col("text").cast("binary"), F.greatest(F.lit(0), F.col("at") - reach)
    texts = wanted.join(long, _is("of", "of_th")).select(
        "anchor", "context", F.substring(data, start + 1, F.col("at") - start).alias("left"), F.substring(data, F.col("at") + 1, F.lit(span)).alias("right"))
    # The rows of a group that is counted window by window need not meet; at most one anchor in ``group`` rows is named here.
    crowded = wanted.groupBy("anchor").count().where(F.col("count") > group).select("anchor", F.lit(True).alias("crowded"))
    texts = texts.join(F.broadcast(crowded), "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    by_suffix = texts.repartition("anchor", F.when(F.col("crowded"), F.col("context"))).sortWithinPartitions("anchor", "right")
    shifts = settle(by_suffix.mapInArrow(_shared_shifts(span, gram, group), "context binary, low int, high int, windows binary"), "shifts")

    windows = shifts.where("windows is not null").select("context", "low", "windows", F.explode(F.sequence(F.lit(0), F.expr("octet_length(windows) div 16 - 1"))).alias("k"))
    windows = settle(windows.select("context", (F.col("low") + F.col("k")).alias("shift"), F.substring("windows", F.col("k") * 16 + 1, F.lit(16)).alias("window")), "windows")
    counts = settle(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).select("window", "n", (F.col("n") > 1).alias("again")), "counts")
    far = lookup(windows, counts, "window", "n").where("again").groupBy("context").agg(F.min("shift").alias("low"), F.max("shift").alias("high"))

    verdicts = shifts.where("windows is null").select("context", "low", "high").unionByName(far)
    single = members.where("not whole").join(verdicts, "context").select("id", "th", (F.col("at") - F.col("high")).alias("low"), (F.col("at") + span - F.col("low")).alias("high"))
    whole = members.where("whole").select("id", "th", (F.col("at") - reach).alias("low"), (F.col("at") + span).alias("high"))
    spans = whole.unionByName(single).groupBy("id", "th").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = spans.select(F.col("id").alias("of"), F.col("th").alias("of_th"), "spans")
    out = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>"
    return per_row(rows.join(spans, _is("of", "of_th"), "left"), ["id", "text", "spans"], _cut(), out)
