"""Collocations from counts that weighted acyclic automata carry.

A task sorts the n-grams of its shard and builds count transducers from them, one for each range of prefixes:
states are prefixes, arcs are words, the weight of a path is its count. The automata of a range are
united over all shards, weights summed, and rare paths pruned. Each length takes one pass over the texts and
looks only at n-grams whose parts are frequent. The parts of a phrase are looked up by running them through the
automata of their ranges.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import lookup, pieces, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Longest phrase, least count of a phrase, and rows reported for each language.
LENGTH, LEAST, KEEP = 4, 30, 2000
#: A phrase goes if it stands inside a longer one that has this percentage of its count or more.
INSIDE = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Words of a shard, and of a prefix range; there are 16 ranges at least and MOST_RANGES at most.
SHARD, RANGE, MOST_RANGES = 1 << 21, 1 << 22, 1 << 16
#: Paths that wait in memory to be united with those of their range.
WAITING = 1 << 20
#: Bits for each frequent n-gram in the filter of the next pass, and bits of the whole filter at most (64 MB).
FILTER_BITS, MOST_BITS = 32, 1 << 29
PIECE = 1 << 20
MARK = b"\xff"  # stands for the end of a piece; no UTF-8 text has it
# Capitals become small, tabs blanks, and what ends a piece becomes MARK.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
PATHS = "lang string, range int, length int, paths bigint, automaton binary"


# Automata. Keys are rows of 64-bit word names, distinct and sorted.


def build(keys: np.ndarray, weights: np.ndarray) -> bytes:
    """Each key adds states from where it leaves the key before it; then labels, numbers of arcs and weights are packed."""
    from zstandard import compress

    m, k = keys.shape
    fresh = np.zeros(m, dtype=bool)
    fresh[0] = True
    out, above = [np.array([m, k], dtype=np.int64).tobytes()], None
    for d in range(k):
        fresh[1:] |= keys[1:, d] != keys[:-1, d]
        states = np.flatnonzero(fresh)
        arcs = np.array([len(states)]) if above is None else np.add.reduceat(fresh.astype(np.int64), above)
        out += [arcs.astype(np.uint32).tobytes(), keys[states, d].tobytes()]
        above = states
    return compress(b"".join([*out, weights.astype(np.int64).tobytes()]), 1)


class Automaton:
    """labels[d]: the arcs at depth d, in order of their states; first[d]: the first arc of each state."""

    def __init__(self, blob: bytes):
        from zstandard import decompress

        data = decompress(blob)
        m, k = np.frombuffer(data, np.int64, 2).tolist()
        at, states = 16, 1
        self.labels, self.first = [], []
        for _ in range(k):
            arcs = np.frombuffer(data, np.uint32, states, at).astype(np.int64)
            at += 4 * states
            self.first.append(np.concatenate([[0], np.cumsum(arcs)]))
            states = int(self.first[-1][-1])
            self.labels.append(np.frombuffer(data, np.uint64, states, at))
            at += 8 * states
        self.weights = np.frombuffer(data, np.int64, m, at)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, in order, and their weights."""
        columns, state = [], np.arange(len(self.weights))
        for d in reversed(range(len(self.labels))):
            columns.append(self.labels[d][state])
            state = np.searchsorted(self.first[d], state, side="right") - 1
        return np.stack(columns[::-1], axis=1), self.weights

    def weigh(self, keys: np.ndarray) -> np.ndarray:
        """The weights of these keys, 0 where there is no such path: all keys take one arc at a time."""
        state, alive = np.zeros(len(keys), dtype=np.int64), np.ones(len(keys), dtype=bool)
        for d, labels in enumerate(self.labels):
            low, high = self.first[d][state], self.first[d][state + 1]
            end = high.copy()
            while (low < high).any():
                middle = (low + high) >> 1
                less = (low < high) & (labels[np.minimum(middle, len(labels) - 1)] < keys[:, d])
                low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
            alive &= low < end
            state = np.where(alive, low, 0)
            alive &= labels[state] == keys[:, d]
            state = np.where(alive, state, 0)
        return np.where(alive, self.weights[state], 0)


def unite(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted set of keys with the sums of their weights."""
    keys, weights = np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts])
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[starts], np.add.reduceat(weights[order], starts)


# Names of words and n-grams.


def _named(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    head = lang.encode("utf-8", "replace") + MARK
    return np.array([xxh3_64_intdigest(head + w, seed) for w in words], dtype=np.uint64)


def _gram(columns: list[np.ndarray]) -> np.ndarray:
    x = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        x = x * np.uint64(0x9E3779B97F4A7C15) + c
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    return x


def _ranges(keys: np.ndarray, many: int) -> np.ndarray:
    return ((_gram([keys[:, d] for d in range(min(2, keys.shape[1]))]) >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int32)


def _places(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return gram >> shift, (gram * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift


def _passes(kept: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Which n-grams may be frequent: all that are, and a few others."""
    found = np.ones(len(gram), dtype=bool)
    for p in _places(gram, 64 * len(kept)):
        found &= (kept[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(b" ", start, start + PIECE)
        cut = cut if cut > start else text.find(b" ", start + PIECE)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _shards(batches: Iterator[pa.RecordBatch], carry: int, limit: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words, their numbers in the order of the texts) of shards of about ``limit`` words; 0 ends a piece.

    A text that goes on in the next shard brings its last ``carry`` words along.
    """
    held: dict[str, tuple[Ids, list[np.ndarray]]] = {}
    total = 0

    def drain() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, (ids, arrays) in held.items():
            yield lang, list(ids), np.concatenate(arrays)
        held.clear()

    for batch in batches:
        for part in pieces(batch, 1, PIECE):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if text.is_valid:
                    texts.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            for lang, found in texts.items():
                whole = (b" " + MARK + b" ").join([*found, b""]).translate(NORMAL).replace(MARK, b" " + MARK + b" ")
                for chunk in _chunks(whole):
                    ids, arrays = held.setdefault(lang, (Ids({MARK: 0}), []))
                    words = chunk.split()
                    arrays.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                    total += len(words)
                    if total >= limit:
                        known, tail = list(ids), np.concatenate(arrays) if carry else []
                        last = [known[k] for k in tail[-carry:]] if carry else []
                        yield from drain()
                        total = 0
                        if last:
                            ids = Ids({MARK: 0})
                            held[lang] = ids, [np.array([ids[w] for w in last], dtype=np.int32)]
    yield from drain()


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, at in _shards(batches, 0, SHARD):
            counts = np.bincount(at, minlength=len(words))[1:]
            names = _named(lang, words[1:], seed).view(np.int64)
            columns = [pa.array([lang] * len(names), pa.string()), pa.array(names), pa.array(words[1:], pa.binary()), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "name", "word", "n"])

    return run


def _rows(lang: str, keys: np.ndarray, weights: np.ndarray, many: int) -> Iterator[tuple]:
    """Automata of a shard, one for each range; keys are sorted."""
    ranges = _ranges(keys, many)
    order = np.argsort(ranges, kind="stable")
    cuts = np.flatnonzero(np.diff(ranges[order])) + 1
    for rows in np.split(order, cuts):
        yield lang, int(ranges[rows[0]]), keys.shape[1], len(rows), build(keys[rows], weights[rows])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["lang", "range", "length", "paths", "automaton"])


def _word_automata(many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = batch.column(1).to_numpy().view(np.uint64)[:, None], batch.column(2).to_numpy()
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            out = [r for lang in set(langs) for r in _rows(lang, *unite([(names[langs == lang], n[langs == lang])]), many)]
            if out:
                yield _batch(out)

    return run


def _windows(at: np.ndarray, names: np.ndarray, length: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the n-grams of one length whose parts pass the filters, sorted."""
    fine = _passes(filters[0], _gram([names]))
    fine[0] = False
    open_ = fine[at]
    for k in range(2, length + 1):
        open_ = open_[:-1] & open_[1:]
        if k < length:
            here = np.flatnonzero(open_)
            open_[here] = _passes(filters[k - 1], _gram([names[at[here + d]] for d in range(k)]))
    here = np.flatnonzero(open_)
    if not len(here):
        return np.empty((0, length), dtype=np.uint64), np.empty(0, dtype=np.int64)
    order = np.argsort(names)
    rank = np.empty(len(names), dtype=np.uint64)
    rank[order] = np.arange(len(names), dtype=np.uint64)
    # Codes in the order of the keys: words are numbered by rank, then pairs by their code, and so on.
    code, back = rank[at[here]], [order]
    for d in range(1, length):
        code = code * np.uint64(len(names)) + rank[at[here + d]]
        if d < length - 1:
            known, inverse = np.unique(code, return_inverse=True)
            back.append(known)
            code = inverse.astype(np.uint64)
    code, counts = np.unique(code, return_counts=True)
    columns = []
    for known in reversed(back[1:]):
        columns.append(order[(code % np.uint64(len(names))).astype(np.int64)])
        code = known[(code // np.uint64(len(names))).astype(np.int64)]
    columns += [order[(code % np.uint64(len(names))).astype(np.int64)], order[(code // np.uint64(len(names))).astype(np.int64)]]
    return names[np.stack(columns[::-1], axis=1)], counts.astype(np.int64)


def _count_grams(length: int, filters: list, many: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [f.value for f in filters]
        for lang, words, at in _shards(batches, length - 1, SHARD):
            keys, counts = _windows(at, _named(lang, words, seed), length, kept)
            if len(keys):
                yield _batch(list(_rows(lang, keys, counts, many)))

    return run


def _unite(least: int):
    """Automata sorted by (language, range) in; one of the paths with the least weight for each out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for (lang, number), group in groupby(rows, key=lambda r: r[:2]):
            held, waiting = [], 0
            for row in group:
                held.append(Automaton(row[4]).paths())
                waiting += row[3]
                if waiting > WAITING:
                    held, waiting = [unite(held)], 0
            keys, weights = unite(held)
            keys, weights = keys[weights >= least], weights[weights >= least]
            if len(keys):
                yield _batch([(lang, number, keys.shape[1], len(keys), build(keys, weights))])

    return run


def united(automata: DataFrame, least: int) -> DataFrame:
    return settle(automata.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(_unite(least), PATHS), "automata")


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys, _ = Automaton(blob).paths()
                place = np.unique(np.concatenate(_places(_gram(list(keys.T)), bits)))
                slot = (place >> np.uint64(6)).astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(slot[starts]), pa.array(value.view(np.int64))], ["slot", "bits"])

    return run


def filter_of(automata: DataFrame) -> np.ndarray:
    """A bit set that all paths pass; its size follows their number up to MOST_BITS, beyond that it passes more."""
    paths = automata.agg(F.sum("paths")).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 16, 1 << int(FILTER_BITS * paths).bit_length()))
    rows = automata.select("automaton").mapInArrow(_bits(bits), "slot bigint, bits bigint").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    kept = np.zeros(bits >> 6, dtype=np.uint64)
    kept[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return kept


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, weights = Automaton(blob).paths()
            offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1).view(np.int64))), pa.array(weights)], ["lang", "key", "a"])


def _add_range(many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=np.int32)
            keys = batch.column(1).to_pylist()
            sizes = np.array([len(k) for k in keys])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                out[rows] = _ranges(np.array([keys[r] for r in rows], dtype=np.int64).view(np.uint64), many)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "range"])

    return run


def _run_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (language, range, length): first the automaton, then the parts that are weighed by it."""
    automaton, at = None, None
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:3]):
            parts = []
            for r in group:
                if r[3] is None:
                    parts.append(r[4])
                else:
                    automaton, at = Automaton(r[3]), key
            if parts:
                keys = np.array(parts, dtype=np.int64).view(np.uint64)
                found = automaton.weigh(keys) if at == key else np.zeros(len(keys), dtype=np.int64)
                out += zip(parts, found.tolist(), strict=True)
        if out:
            parts, found = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.int64())), pa.array(found, pa.int64())], ["part", "f"])


def weighed(parts: DataFrame, automata: DataFrame, many: int) -> DataFrame:
    """(part, f): the counts of distinct parts (lang, part), by the automata of their ranges."""
    asked = parts.select("lang", "part").mapInArrow(_add_range(many), "lang string, part array<bigint>, range int")
    asked = asked.select("lang", "range", F.size("part").alias("length"), F.lit(None).cast("binary").alias("automaton"), "part")
    told = automata.select("lang", "range", "length", "automaton", F.lit(None).cast("array<bigint>").alias("part"))
    both = told.unionByName(asked).repartition("lang", "range", "length")
    return both.sortWithinPartitions("lang", "range", "length", F.col("automaton").isNull()).mapInArrow(_run_through, "part array<bigint>, f bigint")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a / (l + r)) in whole numbers; the product may pass 64 bits."""
    wide = a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, (left + right).cast("decimal(31,0)"))


def count_words(rows: DataFrame) -> tuple[DataFrame, int]:
    """((name, lang, word, n), seed): every word of every language with a 64-bit name that no other word has."""
    for seed in range(16):
        counted = rows.mapInArrow(_count_words(seed), "lang string, name bigint, word binary, n bigint")
        one = F.struct("lang", "word")
        words = settle(counted.groupBy("name").agg(F.min(one).alias("one"), F.max(one).alias("other"), F.sum("n").alias("n")), "words")
        if words.where("one <> other").isEmpty():
            return words.select("name", "one.lang", "one.word", "n"), seed
    raise RuntimeError("no seed tells all words apart")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, keep: int = KEEP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``keep`` best phrases of two to four words of each language.

    A-Z in lower case; pieces end at .,;:!? and line ends, words at blanks and tabs. a is the phrase's count, at least
    ``least``; l and r are the counts of the two parts of its weakest cut, n the words of the language.
    Score, then a, then the phrase in order of bytes decide; phrases inside a longer one with INSIDE percent of
    their count are left out. A null text has no words, a null language is ``und``, repeated rows count again,
    and an empty table gives an empty result. Other columns don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    words, seed = count_words(rows)
    totals = settle(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    many = int(min(MOST_RANGES, max(16, -(-(totals.agg(F.sum("n")).first()[0] or 0) // RANGE))))
    frequent = words.where(F.col("n") >= least)
    by_length = [united(frequent.select("lang", "name", "n").mapInArrow(_word_automata(many), PATHS), least)]
    filters = []
    for length in range(2, LENGTH + 1):
        filters.append(spark.sparkContext.broadcast(filter_of(by_length[-1])))
        by_length.append(united(rows.mapInArrow(_count_grams(length, filters, many, seed), PATHS), least))
    automata = by_length[0]
    for more in by_length[1:]:
        automata = automata.unionByName(more)
    phrases = settle(automata.where("length > 1").select("lang", "automaton").mapInArrow(_explode, "lang string, key array<bigint>, a bigint"), "phrases")
    # Parts of all cuts, each distinct part looked up once.
    size = F.size("key")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("cut"), F.lit(0).alias("side"), F.slice("key", F.lit(1), k).alias("part")),
        F.struct(k.alias("cut"), F.lit(1).alias("side"), F.slice("key", k + 1, size - k).alias("part")))))
    parts = settle(phrases.select("lang", "key", F.explode(cuts).alias("x")).select("lang", "key", "x.*"), "parts")
    asked = settle(parts.groupBy("part").agg(F.first("lang").alias("lang"), F.count(F.lit(1)).alias("w")), "asked")
    told = settle(weighed(asked, automata, many).join(asked.select("part", "w"), "part"), "told")
    at = lambda k, side: F.max(F.when((F.col("cut") == k) & (F.col("side") == side), F.col("f"))).alias(f"f{k}{side}")
    sides = lookup(parts.select("key", "cut", "side", "part"), told, "part", "w").groupBy("key").agg(*[at(k, s) for k in range(1, LENGTH) for s in (0, 1)])
    weakest = F.array_min(F.filter(F.array(*[
        F.when(F.col(f"f{k}0").isNotNull(), F.struct(_score(F.col("a"), F.col(f"f{k}0"), F.col(f"f{k}1")).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r")))
        for k in range(1, LENGTH)]), lambda x: x.isNotNull()))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda s: F.slice("key", s, k))))
    cover = phrases.where(size > 2).select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    own = phrases.join(cover, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
    scored = own.join(sides, "key").withColumn("weak", weakest).select("lang", "key", "a", "weak.score", "weak.l", "weak.r")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    few = settle(scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= keep).drop("place"), "best")
    # Only now the words themselves.
    used = settle(few.select("key", F.posexplode("key").alias("at", "name")), "used")
    spelt = settle(used.groupBy("name").agg(F.count(F.lit(1)).alias("w")).join(frequent.select("name", F.col("word").cast("string").alias("word")), "name"), "spelt")
    texts = lookup(used, spelt, "name", "w").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = few.join(texts, "key").withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH texts AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM texts),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM runs),
grams AS (
  SELECT lang, list_slice(w, p, p + k - 1) AS g, CAST(count(*) AS BIGINT) AS f
  FROM places, range(1, {LENGTH + 1}) AS t(k) WHERE p + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE len(g) = 1 GROUP BY lang),
phrases AS (SELECT lang, g, f AS a FROM grams WHERE len(g) > 1 AND f >= {LEAST}),
cuts AS (
  SELECT x.lang, x.g, a, k, l.f AS l, r.f AS r, CAST((CAST({SCALE} AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM phrases) x
  JOIN grams l ON l.lang = x.lang AND l.g = list_slice(x.g, 1, k) JOIN grams r ON r.lang = x.lang AND r.g = list_slice(x.g, k + 1, len(x.g))),
weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, list_slice(g, s, s + k - 1) AS g, max(a) AS longer
  FROM (SELECT *, unnest(range(1, len(g) - k + 2)) AS s FROM (SELECT *, unnest(range(2, len(g))) AS k FROM phrases)) GROUP BY ALL),
own AS (SELECT weak.* FROM weak LEFT JOIN inner_ USING (lang, g) WHERE longer IS NULL OR 100 * longer < {INSIDE} * a),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM own)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {KEEP}
"""
