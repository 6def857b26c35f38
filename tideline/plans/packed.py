"""Rows and trees in packed form: a task that grows a tree holds all rows of it, a task that scores holds some trees.

A row of features that are mostly indicators takes 8 bytes for each number, one bit for each indicator and 16 for label and
weight; binned for a random forest it takes a byte a feature. So the rows of a large table fit one task, are sent there
once for each tree in a few records, and no level of a tree is written anywhere. Where they do not fit
(``PACKED_BYTES``), callers go on by levels or with Spark's own forest.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ship the functions on rows with the task; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The most bytes of packed rows, or of one tree's nodes, that a task holds.
PACKED_BYTES = 96 << 20
#: Rows of a record of packed rows.
BLOCK_ROWS = 8_192
#: Bytes of a packed node, and of the trees that a task scores with if there are more than one.
NODE_BYTES, TREES_BYTES = 24, 64 << 20
_BLOCKS = "block bigint, n int, body binary"


def matrix(lists: pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def few_values(rows: DataFrame, many: int, most: int) -> list[np.ndarray | None]:
    """Sorted values of each number in ``x``, or None where there are more than ``most``."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.array([])] * many
        for batch in batches:
            x = matrix(batch.column("x"), batch.num_rows)
            for f in range(many):
                if len(seen[f]) <= most:
                    seen[f] = np.union1d(seen[f], x[:, f])[: most + 1]
        yield pa.RecordBatch.from_pydict({"f": pa.array(np.repeat(np.arange(many, dtype=np.int32), [len(s) for s in seen])), "v": pa.array(np.concatenate(seen), pa.float64())})

    found = rows.select("x").mapInArrow(values, "f int, v double").groupBy("f").agg(F.slice(F.array_sort(F.collect_set("v")), 1, most + 1).alias("v"))
    known = {r["f"]: np.array(r["v"]) for r in found.collect()}  # one row for each number, a few values in each
    return [v if len(v) <= most else None for v in (known.get(f, np.array([])) for f in range(many))]


def blocks(rows: DataFrame, body: Callable[[pa.RecordBatch], bytes], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``block, n, body``: rows in packed records, numbered in the order of the table's parts."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                part = batch.slice(start, block_rows)
                yield pa.RecordBatch.from_pydict({"block": pa.array([at]), "n": pa.array([part.num_rows], pa.int32()), "body": pa.array([body(part)], pa.binary())})
                at += 1

    return rows.mapInArrow(packed, _BLOCKS)


def by_tree(packed: DataFrame, num_trees: int, grow: Callable[[int, list[tuple[int, bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each tree grown in a task of its own by ``grow(tree, records)`` from all packed rows, in their order."""
    dealt = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1))).alias("tree"))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, records = None, []
        for batch in batches:
            for n, body, tree in zip(*(batch.column(c) for c in ("n", "body", "tree")), strict=True):
                records.append((n.as_py(), body.as_buffer()))
        if records:
            yield from grow(tree.as_py(), records)

    return dealt.repartitionById(num_trees, "tree").sortWithinPartitions("block").mapInArrow(grown, schema)


@dataclass(frozen=True)
class Layout:
    """Which of ``many`` features are indicators (0 or 1, a bit each) and which are numbers."""

    many: int
    numbers: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(indicators: Sequence[bool]) -> Layout:
        mark = np.array(indicators, bool)
        return Layout(len(mark), np.flatnonzero(~mark), np.flatnonzero(mark))

    @property
    def words(self) -> int:
        return -(-len(self.bits) // 64)

    @property
    def row_bytes(self) -> int:
        return 8 * (len(self.numbers) + self.words + 2)

    def pack(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers by row, and words of bits by row."""
        words = np.zeros((self.words, len(x)), np.uint64)
        for j, f in enumerate(self.bits):
            words[j // 64] |= (x[:, f] != 0).astype(np.uint64) << np.uint64(j % 64)
        return np.ascontiguousarray(x[:, self.numbers].T), words

    def unpack(self, numbers: np.ndarray, words: np.ndarray) -> np.ndarray:
        """All features as a matrix of rows."""
        out = np.empty((numbers.shape[1], self.many))
        out[:, self.numbers] = numbers.T
        for j, f in enumerate(self.bits):
            out[:, f] = (words[j // 64] >> np.uint64(j % 64)) & np.uint64(1)
        return out

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For each feature whether it is a number, and its place among the numbers or bits."""
        number, place = np.zeros(self.many, bool), np.zeros(self.many, np.int64)
        number[self.numbers], place[self.numbers], place[self.bits] = True, np.arange(len(self.numbers)), np.arange(len(self.bits))
        return number, place

    def body(self, batch: pa.RecordBatch) -> bytes:
        numbers, words = self.pack(matrix(batch.column("x"), batch.num_rows))
        return b"".join((numbers.tobytes(), words.tobytes(), *(batch.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("label", "weight"))))

    def read(self, records: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, words, label and weight of all rows."""
        d, parts = len(self.numbers), ([], [], [], [])
        for n, body in records:
            flat = np.frombuffer(body, np.float64)
            parts[0].append(flat[: d * n].reshape(d, n))
            parts[1].append(flat[d * n : (d + self.words) * n].view(np.uint64).reshape(self.words, n))
            parts[2].append(flat[-2 * n : -n])
            parts[3].append(flat[-n:])
        records.clear()
        return tuple(np.concatenate(p, axis=-1) for p in parts)


def parted(right: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row goes when the rows of every node are parted, left ones first, in their order; and the left rows of each node."""
    to_right = np.cumsum(right)
    before = to_right[first] - right[first]
    left = n - (to_right[first + n - 1] - before)
    on_right = to_right - np.repeat(before, n)  # right rows of the node up to this one
    inside = np.arange(len(right)) - np.repeat(first, n)
    return np.repeat(first, n) + np.where(right, np.repeat(left, n) + on_right - 1, inside - on_right), left


def _packed_tree(nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("node")
    ids = nodes["node"].to_numpy()
    feature = nodes["feature"].fill_null(-1).to_numpy().astype(np.int32)
    below = np.searchsorted(ids, 2 * ids + 1).astype(np.int32)  # the right child's number is the next one
    body = b"".join(a.tobytes() for a in (nodes["threshold"].fill_null(0.0).to_numpy(), nodes["value"].to_numpy(), feature, below))
    return pa.table({"tree": pa.array([nodes["tree"][0].as_py()], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "body": pa.array([body], pa.binary())})


def leaf_values(feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, below: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of ``x`` comes to; ``below`` is the place of a node's left child, which the right one follows."""
    out, rows, at = np.empty(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(rows):
        f = feature[at]
        inner = f >= 0
        if not inner.all():
            out[rows[~inner]] = value[at[~inner]]
            rows, at, f = rows[inner], at[inner], f[inner]
        at = below[at] + ~(x[rows, f] <= threshold[at])
    return out


def score_trees(nodes: DataFrame, rows: DataFrame, num_trees: int) -> DataFrame | None:
    """``__row, __p``: the mean of the trees' leaf values for ``rows`` (``__row, __x``); None where one tree is too large for a task."""
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    if largest * NODE_BYTES > PACKED_BYTES:
        return None
    held = max(1, TREES_BYTES // (NODE_BYTES * max(1, largest)))
    groups = -(-num_trees // held)
    chunks = max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // groups))
    trees = nodes.select("tree", "node", "feature", "threshold", "value").groupBy("tree").applyInArrow(_packed_tree, "tree int, n int, body binary")
    width = lambda b: matrix(b.column("__x"), b.num_rows)
    body = lambda b: b.column("__row").to_numpy().tobytes() + width(b).tobytes()
    group, chunk = F.lit(groups), F.lit(chunks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    standing = trees.select(F.lit(0).alias("kind"), F.col("tree").cast("bigint").alias("id"), "n", "body", F.pmod("tree", group).alias("g"), every(chunks).alias("c"))
    passing = blocks(rows, body, BLOCK_ROWS // 2).select(F.lit(1).alias("kind"), F.col("block").alias("id"), "n", "body", every(groups).alias("g"), F.pmod(F.xxhash64("block"), chunk).cast("int").alias("c"))
    dealt = standing.unionByName(passing).withColumn("to", F.col("g") * chunk + F.col("c"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = []
        for batch in batches:
            for kind, n, body in zip(*(batch.column(c) for c in ("kind", "n", "body")), strict=True):
                n, body = n.as_py(), body.as_buffer()
                if kind.as_py() == 0:
                    numbers, places = np.frombuffer(body, np.float64, 2 * n), np.frombuffer(body, np.int32, 2 * n, 16 * n)
                    here.append((places[:n].copy(), numbers[:n].copy(), numbers[n:].copy(), places[n:].copy()))
                    continue
                ids, x = np.frombuffer(body, np.int64, n), np.frombuffer(body, np.float64, offset=8 * n).reshape(n, -1)
                total = np.zeros(n)
                for tree in here:
                    total += leaf_values(*tree, x)
                yield pa.RecordBatch.from_pydict({"__row": pa.array(ids), "part": pa.array(total)})

    parts = dealt.repartitionById(groups * chunks, "to").sortWithinPartitions("kind", "id").mapInArrow(scored, "__row bigint, part double")
    if groups > 1:  # in one order, so that equal rows have equal scores
        total = F.aggregate(F.sort_array(F.collect_list("part")), F.lit(0.0), lambda a, v: a + v)
        parts = parts.groupBy("__row").agg(total.alias("part"))
    return parts.select("__row", (F.col("part") / F.lit(num_trees)).alias("__p"))
