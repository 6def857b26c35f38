"""Benchmark decontamination: a broadcast hash set of test windows, a scan, and exact checks of the hits.

A benchmark of up to ``BLOCK_BYTES`` travels whole with the scan. Of a larger one the windows are a table and only a bit
filter of their hashes travels, whose size is bounded; document windows that pass it are joined with the table.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, lookup, pieces, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
#: Bytes of benchmark text that the scan carries; a larger benchmark stays a table.
BLOCK_BYTES = 16 << 20
#: The bit filter has sixteen bits for each window, within these powers of two (64 MB at most).
LEAST_BITS, MOST_BITS = 16, 29
#: Rows of a batch that the scan gives out.
OUT_ROWS = 20_000
#: A document is dropped if this share of its words is hit; otherwise the hit spans are cut out.
DROP_SHARE = 0.5
PIECE = 4 << 20
STATE = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, items: array<string>, spans: array<struct<start: int, stop: int>>, clean_text: string>"

# ASCII but for letters and digits separates words; capitals become small; other bytes stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The windows of a block of items: word numbers, hashes of windows by length, exact owners."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.words: dict[bytes, int] = {}
        self.owners: dict[tuple[int, ...], set[str]] = {}
        hashes: dict[int, set[int]] = {}
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in text.translate(NORMAL).split()]
            length = min(WINDOW, len(ids))
            for at in range(len(ids) - length + 1 if ids else 0):
                window = tuple(ids[at : at + length])
                owners = self.owners.setdefault(window, set())
                if item is not None:
                    owners.add(item)
                hashes.setdefault(length, set()).add(int(_hashes(np.array(window, dtype=np.int64), np.array([0]), length)[0]))
        self.hashes = {n: np.array(sorted(h), dtype=np.uint64) for n, h in hashes.items()}

    def numbers(self, words: list[bytes]) -> list[int]:
        return list(map(self.words.get, words, repeat(0)))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(position, length, owners) of every window that occurs; number 0 is no word of any item."""
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, known in self.hashes.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(at):
                continue
            h = _hashes(ids, at, length)
            slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for p in at[known[slot] == h].tolist():
                owners = self.owners.get(tuple(ids[p : p + length].tolist()))
                if owners is not None:
                    yield p, length, owners


def _hashes(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(length):
        h = (h ^ ids[at + k].astype(np.uint64)) * BASE
        h ^= h >> np.uint64(29)
    return h


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    ends = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at : ends[start][0]])
        at = ends[stop - 1][1]
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def _scan(items: list[tuple[str | None, bytes]], text_at: int, with_text: bool):
    """A pass over documents for the given items; the last column is what is already known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        windows = Windows(items)
        for batch in batches:
            for part in pieces(batch, text_at, PIECE):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(text_at)]
                before = part.column(part.num_columns - 1).to_pylist()
                ids: list[int] = []
                starts, counts = [], []
                for text in texts:
                    words = text.translate(NORMAL).split()
                    starts.append(len(ids))
                    counts.append(len(words))
                    ids += windows.numbers(words)
                    ids.append(0)
                spans = [[(s["start"], s["stop"]) for s in x["spans"]] if x else [] for x in before]
                owners = [set(x["items"]) if x else set() for x in before]
                for at, length, who in windows.hits(np.array(ids, dtype=np.int64)):
                    row = bisect_right(starts, at) - 1
                    spans[row].append((at - starts[row], at - starts[row] + length))
                    owners[row] |= who
                out = []
                for text, n, found, who in zip(texts, counts, spans, owners, strict=True):
                    found, names = _merged(found), sorted(who)
                    out.append({
                        "n_words": n, "n_hit": sum(b - a for a, b in found), "n_items": len(names),
                        "items_sha256": sha256(",".join(names).encode()).hexdigest(), "contaminated": bool(found),
                        "items": names, "spans": [{"start": a, "stop": b} for a, b in found],
                        "clean_text": _cut(text, found) if with_text and found else None,
                    })
                state = pa.array(out, type=batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], state], schema=batch.schema)

    return run


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) -> item, length, hash of the words, words."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        rows: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.translate(NORMAL).split()
            length = min(WINDOW, len(words))
            for at in range(len(words) - length + 1 if words else 0):
                joined = b" ".join(words[at : at + length])
                rows.append((item, length, xxh64_intdigest(joined) >> 1, joined))
            if len(rows) >= OUT_ROWS:
                yield _batch(rows, [pa.string(), pa.int32(), pa.int64(), pa.binary()], ["item", "length", "h", "words"])
                rows = []
        yield _batch(rows, [pa.string(), pa.int32(), pa.int64(), pa.binary()], ["item", "length", "h", "words"])


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


def _passing(lengths: list[int], sent):
    """(digest, text) -> digest, first, start, stop, words of every window whose hash passes the filter; ``first`` marks a text's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        bits, types, names = sent.value, [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()], ["digest", "first", "start", "stop", "words"]
        mask = len(bits) * 8 - 1
        for batch in batches:
            rows: list[tuple] = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, first = text.translate(NORMAL).split(), True
                for length in lengths:
                    for at in range(len(words) - length + 1):
                        joined = b" ".join(words[at : at + length])
                        h = (xxh64_intdigest(joined) >> 1) & mask
                        if bits[h >> 3] >> (h & 7) & 1:
                            rows.append((digest, first, at, at + length, joined))
                            first = False
                            if len(rows) >= OUT_ROWS:
                                yield _batch(rows, types, names)
                                rows = []
            yield _batch(rows, types, names)

    return run


def _bit_filter(windows: DataFrame) -> bytes:
    """Bits of the windows' hashes: made by aggregation in parts of 4 KB, at most 64 MB in all."""
    many = windows.agg(F.approx_count_distinct("h")).first()[0]
    power = min(MOST_BITS, max(LEAST_BITS, (16 * many).bit_length()))
    place = F.col("h").bitwiseAND(F.lit((1 << power) - 1)) + 1
    parts = windows.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(1 << (power - 3))
    for r in parts.toLocalIterator():
        at = (r["part"] - 1) << 12
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def _by_join(docs: DataFrame, items: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with the windows found in them as the column ``out``; equal texts are looked up once.

    Only windows that pass the filter are shuffled. Words are the join key, so a match is a match word by word. Windows and
    texts with very many rows are joined by broadcast (at most a thousand of them).
    """
    windows = settle(items.mapInArrow(_item_windows, "item string, length int, h bigint, words binary").distinct(), "windows")
    lengths = sorted((r["length"] for r in windows.select("length").distinct().collect()), reverse=True)  # at most ten
    sent = docs.sparkSession.sparkContext.broadcast(_bit_filter(windows))
    digest = fresh(docs, "__digest")
    keyed = docs.withColumn(digest, F.md5(F.col(f"`{text_col}`").cast("binary")))
    texts = keyed.where(F.col(digest).isNotNull()).select(digest, F.col(f"`{text_col}`").cast("binary"))
    passed = settle(texts.mapInArrow(_passing(lengths, sent), "digest string, first boolean, start int, stop int, words binary"), "passed")
    asked = windows.select("words").distinct().join(passed.groupBy("words").agg(F.count(F.lit(1)).alias("weight")), "words")
    hits = settle(lookup(passed, settle(asked.withColumn("hit", F.lit(True)), "asked"), "words", "weight").where("hit"), "hits")
    spans = hits.groupBy("digest").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    owners = hits.select("digest", "words").distinct().join(windows.where("item is not null").select("words", "item"), "words")
    named = owners.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = passed.where("first").groupBy("digest").agg(F.count(F.lit(1)).alias("weight"))
    state = F.struct(
        F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast("bigint").alias("n_hit"), F.lit(None).cast("bigint").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"),
        F.lit(None).cast("boolean").alias("contaminated"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", F.lit(None).cast("string").alias("clean_text"),
    )
    found = settle(spans.join(named, "digest", "left").join(rows, "digest").select(F.col("digest").alias(digest), "weight", state.cast(STATE).alias(out)), "found")
    weight = fresh(keyed, "__weight")
    return lookup(keyed, found.withColumnRenamed("weight", weight), digest, weight).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{out}`"))


def scan_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    out: str = "leak", with_text: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add a struct column ``out`` that says which windows of the benchmark a document holds.

    A window is ten consecutive words of an item, or all words of a shorter one; a document word in
    any occurrence is hit. Hash matches are checked word by word. Fields: n_words, n_hit, n_items,
    items_sha256, contaminated, items, spans (of words, merged) and, on request, clean_text without the
    spans. A null text has no words; items with null or wordless text have no window; windows of items
    without an id are hit but not listed. Repeated rows each have their result. A benchmark of up to ``block_bytes``
    goes with the tasks and documents are not shuffled. A larger one never comes to the driver or into a task: see
    :func:`_by_join`; the result is the same.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("binary").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text_at = docs.columns.index(text_col)
    if total <= block_bytes:
        carried, work = [(r["id"], bytes(r["text"])) for r in items.collect()], docs.withColumn(out, F.lit(None).cast(STATE))
    else:
        carried, work = [], _by_join(docs, items, text_col, out)
    return work.mapInArrow(_scan(carried, text_at, with_text), work.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = DROP_SHARE) -> DataFrame:
    """Documents without benchmark passages: mostly hit ones go, from the others the hit spans are cut.

    A null text has nothing to hit and stays; repeated rows are treated alike; an empty table gives an empty one.
    """
    leak = fresh(docs, "__leak")
    found = scan_benchmark(docs, benchmark, out=leak, with_text=True)
    kept = found.where(F.col(f"{leak}.n_hit") <= drop_share * F.col(f"{leak}.n_words"))
    cleaned = F.when(F.col(f"{leak}.contaminated"), F.col(f"{leak}.clean_text")).otherwise(F.col("text"))
    return kept.select(*[cleaned.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
