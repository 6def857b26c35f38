"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked tokens.

Records (pair of tokens, document) leave the tokenizing tasks as zstd runs: sorted, one for each part of a radix
partition by the second tokenizer's token (the side). A heap merges the runs of a part and counts each pair,
in side-major order; the greatest count of each side follows. The runs are then read once more and stream the
counts back to their documents. Shuffles carry packed runs, never single records.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import pieces, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts of the radix partition, records of a run before it is cut in parts, and runs that one heap merges.
RADIX, RUN, MERGED = 16, 1 << 18, 64
#: Bits of a first-side token in the number of a pair.
SIDE = 17
PIECE = 1 << 19
#: Words that a task keeps with their tokens: so many, of so many characters in all; beyond it starts anew.
WORDS, CHARS = 1 << 18, 1 << 23
#: Both tokenizers end a token before a single blank between other signs, so words can be aligned one by one.
BLANK, SPACES = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"^ | $|\s | \s")
ALIGNED = "row bigint, id {}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, radix int, keys binary, refs binary"
NAMES = ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "radix", "keys", "refs"]


def vocabulary_files(first: str | None = None, second: str | None = None) -> tuple[str, bytes]:
    """Contents of the byte-level BPE (JSON) and of the sentencepiece model; the public files without given paths."""
    if first is None or second is None:
        import public_tokenizers

        first, second = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
    with open(first, encoding="utf-8") as a, open(second, "rb") as b:
        return a.read(), b.read()


class Tokenizers:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, files: tuple[str, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_str(files[0]), SentencePieceProcessor(model_proto=files[1])
        self.first.encode_special_tokens = True
        self.first.no_padding()
        self.first.no_truncation()
        # Byte-level entries write printable bytes as themselves and the others from U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        entries = self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.first_bytes[number] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.second_bytes = []
        for number in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(number)
            self.second_bytes.append(bytes([int(piece[1:-1], 16)]) if self.second.is_byte(number) else piece.replace("▁", " ").encode())
        self.first_sizes, self.second_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.first_bytes, self.second_bytes))
        # Groups as text: a token is followed by a comma, or by what ends its half of the group.
        n, m = len(self.first_bytes), len(self.second_bytes)
        self.written = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]

    def pairs(self) -> int:
        """No corpus has more linked pairs: of two tokens that end together one is the end of the other."""
        return int(self.first_sizes.sum() + self.second_sizes.sum())

    def encode(self, words: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids on both sides; no ids where the tokens' bytes are not those of a blank and the word."""
        out = []
        first = self.first.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
        for word, a, b in zip(words, first, self.second.encode(words, num_threads=1), strict=True):
            want = b" " + word.encode("utf-8", "replace")
            same = b"".join(map(self.first_bytes.__getitem__, a.ids)) == want == b"".join(map(self.second_bytes.__getitem__, b))
            out.append((a.ids, b) if word and same else ([], []))
        return out

    def align(self, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(tokens on both sides, groups as text, number of groups) of each word, and the linked pairs of all."""
        ids = self.encode(words)
        n, m = len(self.first_bytes), len(self.second_bytes)
        counts = np.array([(len(a), len(b)) for a, b in ids], dtype=np.int64).reshape(-1, 2)
        a = np.array([x for d, _ in ids for x in d], dtype=np.int64)
        b = np.array([x for _, d in ids for x in d], dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.first_sizes[a]), np.cumsum(self.second_sizes[b])
        # The bytes of both sides are the same word after word, so ends can be compared over all of them.
        is_end = np.zeros((2, (ends_a[-1] if len(a) else 0) + 1), dtype=bool)
        is_end[0, ends_a], is_end[1, ends_b] = True, True
        last_a, last_b = is_end[1, ends_a], is_end[0, ends_b]
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        stop_a, stop_b = np.cumsum(counts, axis=0).T
        code = np.empty(len(a) + len(b), dtype=np.int64)
        before = np.concatenate([[0], at_b + 1])[np.cumsum(last_a) - last_a]
        code[np.arange(len(a)) + before] = a + n * last_a
        before = (at_a + 1)[np.cumsum(last_b) - last_b]
        code[np.arange(len(b)) + before] = b + 2 * n + m * last_b
        texts = list(map(self.written.__getitem__, code.tolist()))
        cuts = [0, *(stop_a + stop_b).tolist()]
        written = ["".join(texts[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]
        return counts, written, np.diff(np.searchsorted(at_a, stop_a), prepend=0), b[at_b] << SIDE | a[at_a]


class Known:
    """Words aligned so far: a number for each, and what it stands for."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self.counts, self.groups, self.pairs = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.chars = 0

    def add(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > WORDS or self.chars > CHARS:
            self.clear()
            new = list(words)
        if not new:
            return
        counts, written, groups, pairs = self.tokenizers.align(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.written += written
        self.chars += sum(map(len, new))
        self.counts, self.groups = np.concatenate([self.counts, counts]), np.concatenate([self.groups, groups])
        self.pairs = np.concatenate([self.pairs, pairs])

    def of(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(tokens on both sides, number of groups, their text) of each list of words, and the linked pairs of all."""
        self.add({w for part in words for w in part})
        at = np.array([self.number[w] for part in words for w in part], dtype=np.int64)
        stop = np.cumsum([len(part) for part in words])
        whole = np.ones(len(words), dtype=bool)
        whole[np.searchsorted(stop, np.flatnonzero(self.groups[at] == 0), side="right")] = False
        stop = np.concatenate([[0], stop])
        at = at[np.repeat(whole, np.diff(stop))]
        stop = np.concatenate([[0], np.cumsum(np.diff(stop) * whole)])
        numbers = at.tolist()
        texts = ["".join(map(self.written.__getitem__, numbers[s:e]))[:-1] for s, e in zip(stop, stop[1:], strict=False)]
        sums = lambda x: np.diff(np.concatenate([np.zeros_like(x[:1], shape=(1, *x.shape[1:])), np.cumsum(x[at], axis=0)])[stop], axis=0)
        many = self.groups[at]
        first = np.cumsum(self.groups) - self.groups
        pairs = self.pairs[np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        return sums(self.counts), sums(self.groups), texts, pairs


def _words(text: str | None) -> list[str]:
    return [] if not text else BLANK.split(text) if SPACES.search(text) else text.split(" ")


def _pack(*arrays: np.ndarray) -> bytes:
    from zstandard import compress

    return compress(np.array([len(a) for a in arrays], dtype=np.int64).tobytes() + b"".join([a.tobytes() for a in arrays]), 1)


def _unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    from zstandard import decompress

    data, out, at = decompress(blob), [], 8 * len(types)
    for kind, n in zip(types, np.frombuffer(data, np.int64, len(types)).tolist(), strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _run(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Records as sorted, packed runs (part, keys with totals, documents of each key), one for each part."""
    part = (keys >> SIDE) % RADIX
    order = np.lexsort((rows, keys, part))
    keys, rows, part = keys[order], rows[order], part[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])]))
    times = np.diff(np.append(starts, len(keys)))
    keys, rows, part = keys[starts], rows[starts], part[starts]
    for here in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(part)) + 1):
        k, r, m = keys[here], rows[here], times[here]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        base = r.min()
        refs = _pack(np.array([base]), np.diff(np.append(first, len(k))).astype(np.uint32), (r - base).astype(np.uint32), m.astype(np.uint32))
        yield int(part[here[0]]), _pack(np.diff(k[first], prepend=0), np.add.reduceat(m, first)), refs


def _align(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Tokenizers(files.value))
        row = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting, kind = 0, None

        def runs() -> pa.RecordBatch:
            found = list(_run(np.concatenate([k for k, _ in held]), np.concatenate([r for _, r in held])))
            nulls = [pa.nulls(len(found), t) for t in (pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.string())]
            part, keys, refs = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([*nulls, pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(refs, pa.binary())], NAMES)

        for batch in batches:
            kind = batch.column(0).type
            for piece in pieces(batch, 1, PIECE):
                texts = piece.column(1).to_pylist()
                counts, groups, written, pairs = known.of([_words(t) for t in texts])
                digests = [sha256(w.encode()).hexdigest() if w else "" for w in written]
                rows = np.arange(row, row + len(texts))
                row += len(texts)
                none = pa.nulls(len(texts), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), piece.column(0), pa.array(counts[:, 0]), pa.array(counts[:, 1]), pa.array(groups), pa.array(digests, pa.string()), pa.nulls(len(texts), pa.int32()), none, none], NAMES,
                )
                if len(pairs):
                    held.append((pairs, np.repeat(rows, groups)))
                    waiting += len(pairs)
                    if waiting >= RUN:
                        yield runs()
                        held, waiting = [], 0
        if held:
            yield runs()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (part, slice) in; each pair with its count in the slice out, in side-major order."""

    def merged(blobs: list[bytes]) -> pa.RecordBatch:
        runs = []
        for blob in blobs:
            steps, totals = _unpack(blob, np.int64, np.int64)
            runs.append(zip(np.cumsum(steps).tolist(), totals.tolist(), strict=True))
        keys, counts = [], []
        for key, n in heapq.merge(*runs):
            if keys and keys[-1] == key:
                counts[-1] += n
            else:
                keys.append(key)
                counts.append(n)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["pair", "n"])

    held, at = [], None
    for batch in batches:
        for part, slice_, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and ((part, slice_) != at or len(held) >= 2 * MERGED):
                yield merged(held)
                held = []
            held.append(blob)
            at = part, slice_
    if held:
        yield merged(held)


def _contribute(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total, best = counts.value
        for batch in batches:
            for keys, refs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                steps, _ = _unpack(keys, np.int64, np.int64)
                base, many, rows, times = _unpack(refs, np.int64, np.uint32, np.uint32, np.uint32)
                at = np.repeat(np.searchsorted(pairs, np.cumsum(steps)), many)
                order = np.argsort(rows, kind="stable")
                rows, times, at = rows[order], times[order].astype(np.int64), at[order]
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                sums = [np.add.reduceat(times * x[at], starts) for x in (best, total)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[starts].astype(np.int64) + base[0]), *map(pa.array, sums)], ["row", "n_best", "count_sum"])

    return run


def pair_counts(runs: DataFrame) -> DataFrame:
    """(pair, n, is_best): how many links of the corpus hold each pair; is it its side's highest count, ties included?"""
    sliced = F.greatest(F.lit(1), F.ceil(F.lit(runs.count()) / (RADIX * MERGED)))
    slices = runs.select("radix", F.pmod(F.xxhash64("keys"), sliced).alias("slice"), "keys")
    merged = slices.repartition("radix", "slice").sortWithinPartitions("radix", "slice").mapInArrow(_merge, "pair bigint, n bigint")
    counts = merged.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("side", F.shiftright("pair", SIDE))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(W.partitionBy("side"))).cast("bigint").alias("is_best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each whole text.

    A group ends where tokens of both sides end together; its last two tokens are linked. Without tokens, and with
    the empty string for a hash, are texts that are null or empty and those that either side does not give
    back as they are (the second takes U+2581 for a blank). Repeated rows and rows without an id count
    like any other; an empty table gives an empty one. ``first`` and ``second`` are paths of vocabulary files.

    The driver and each task hold one number for each pair of tokens; there are at most as many as
    both vocabularies have bytes (about half a million), whatever the corpus.
    """
    spark = docs.sparkSession
    files = vocabulary_files(first, second)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    aligned = settle(rows.mapInArrow(_align(spark.sparkContext.broadcast(files)), ALIGNED.format(dict(rows.dtypes)["id"])), "aligned")
    runs = aligned.where("radix is not null").select("radix", "keys", "refs")
    counts = pair_counts(runs).toArrow()
    bound = Tokenizers(files).pairs()
    if counts.num_rows > bound:
        raise RuntimeError(f"{counts.num_rows} pairs of tokens; the vocabularies allow {bound}")
    pairs, total, best = (counts.column(k).to_numpy() for k in range(3))
    order = np.argsort(pairs)
    known = spark.sparkContext.broadcast((pairs[order], total[order], best[order]))
    back = runs.select("keys", "refs").mapInArrow(_contribute(known), "row bigint, n_best bigint, count_sum bigint")
    sums = back.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = aligned.where("radix is null").select("row", "id", "n_a", "n_b", "n_groups", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
