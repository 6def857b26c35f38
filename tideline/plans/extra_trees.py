"""Extremely randomised trees, grown level by level over a table, and below a bound node by node.

Where all rows fit a task in packed form (:mod:`tideline.plans.packed`), each tree is grown in a task of its own. Above that
all trees grow side by side on all rows. A level takes two aggregates over (tree, node): the range of every
feature, from which each node draws features that vary and a threshold inside each range, and the class
weights on both sides of the drawn thresholds. A node with few rows leaves the levels: its rows come together once and
the tree below it is grown by the same draws, as the rows of a level would be read and written again for each of
up to thirty more. Nodes are a table; draws are hashes of seed, tree, node and feature, so a run can be repeated, and
all three ways give the same nodes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans import packed
from tideline.plans.packed import Layout, leaf_values, matrix, parted
from tideline.session import BROADCAST_ROWS, stored

# Ship the functions on nodes with the task; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A node's number is that of a binary heap, which fits 64 bits up to this depth.
DEEPEST = 60
#: Levels that are scored between two stored steps.
STRIDE = 5
#: The most rows below which a node leaves the levels, and the most numbers in them.
SUBTREE_ROWS = 100_000
SUBTREE_NUMBERS = 8_000_000
#: Numbers of the ranges and draws of nodes that are worked on at once.
DRAWN_NUMBERS = 500_000
NODES = "tree int, node bigint, depth int, n bigint, weight double, positive double, low array<double>, high array<double>, feature int, threshold double"


def _marked(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if its counted rows are within the library's bound; otherwise joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _subtree_rows(many: int) -> int:
    return max(1, min(SUBTREE_ROWS, SUBTREE_NUMBERS // max(1, many)))


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _hashed(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of int (32 bits) or bigint values after what ``seed`` is the hash of."""
    if values.dtype.itemsize == 4:
        h = seed + _P[4] + np.uint64(4)
        h = _rotated(h ^ (values.astype(np.uint32).astype(np.uint64) * _P[0]), 23) * _P[1] + _P[2]
    else:
        h = seed + _P[4] + np.uint64(8)
        h = _rotated(h ^ (_rotated(values.astype(np.uint64) * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def _draw(node: np.ndarray, of_tree: list[np.ndarray], low: np.ndarray, high: np.ndarray, drawn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that each node draws, those that vary first, with a threshold for each and whether it varies."""
    by_feature, at = of_tree
    varies = (low < high) | (np.isnan(high) & ~np.isnan(low))  # not a number is greater than all numbers
    uniform = lambda f, h: (_hashed(f, _hashed(node, h)[:, None]) >> np.uint64(11)).astype(np.float64) / 2.0**53
    order = np.argsort(np.where(varies, uniform(np.arange(low.shape[1], dtype=np.int32), by_feature), 2.0), axis=1, kind="stable")[:, :drawn]
    least, most = (np.take_along_axis(v, order, axis=1) for v in (low, high))
    with np.errstate(invalid="ignore"):
        at = least + uniform(order.astype(np.int32), at) * (most - least)
    return order, np.where(at < most, at, least), np.take_along_axis(varies, order, axis=1)


def _grown(layout: Layout, numbers: np.ndarray, words: np.ndarray, label: np.ndarray, weight: np.ndarray, tree: int, root: int, bases: tuple[int, int], drawn: int, min_rows: int, deepest: int) -> Iterator[pa.RecordBatch]:
    """All nodes of the tree below one node, itself included, from the rows of that node, a level at a time. ``bases`` are the hashes of the draws' names."""
    depth, many = (root + 1).bit_length() - 1, layout.many
    of_tree = [_hashed(np.array([tree], np.int32), np.array([b], np.int64).astype(np.uint64)) for b in bases]
    is_number, place = layout.places()
    shift = (place % 64).astype(np.uint64)
    some = max(1, DRAWN_NUMBERS // max(1, many))
    node, start = np.array([root], np.int64), np.array([0])
    while len(node):
        n = np.diff(np.append(start, len(label)))
        total, positive = np.add.reduceat(weight, start), np.add.reduceat(weight * label, start)
        low, high = np.fmin.reduceat(numbers, start, axis=1), np.maximum.reduceat(numbers, start, axis=1)
        every, any_ = np.bitwise_and.reduceat(words, start, axis=1), np.bitwise_or.reduceat(words, start, axis=1)  # the least and greatest bits
        varies = ((low < high) | (np.isnan(high) & ~np.isnan(low))).any(axis=0) | (every != any_).any(axis=0)
        grows = (np.minimum.reduceat(label, start) < np.maximum.reduceat(label, start)) & (n >= min_rows) & (depth < deepest) & varies
        feature, threshold = np.full(len(node), -1, np.int32), np.zeros(len(node))
        g = np.flatnonzero(grows)
        if len(g):
            parts = [_draw(node[p], of_tree, layout.unpack(low[:, p], every[:, p]), layout.unpack(high[:, p], any_[:, p]), drawn) for p in np.split(g, range(some, len(g), some))]
            order, at, drawn_varies = (np.concatenate(c) for c in zip(*parts, strict=True))
            if len(g) < len(node):
                kept = np.flatnonzero(np.repeat(grows, n))
                numbers, words, label, weight = numbers[:, kept], words[:, kept], label[kept], weight[kept]
            n_g = n[g]
            slot, first, row = np.repeat(np.arange(len(g)), n_g), np.concatenate([[0], np.cumsum(n_g)[:-1]]), np.arange(len(label))
            positives = weight * label

            def on_left(f, t):
                """Rows at or below their node's threshold of their node's feature."""
                by_number, f_row = is_number[f], f[slot]
                if by_number.all():
                    return numbers[place[f_row], row] <= t[slot]
                bit = (words[place[f_row] // 64, row] >> shift[f_row]) & np.uint64(1) <= t[slot] if not by_number.any() else None
                if bit is None:
                    bit = np.empty(len(row), bool)
                    mine = by_number[slot]
                    for here, number in ((np.flatnonzero(mine), True), (np.flatnonzero(~mine), False)):
                        p = place[f_row[here]]
                        value = numbers[p, here] if number else (words[p // 64, here] >> shift[f_row[here]]) & np.uint64(1)
                        bit[here] = value <= t[slot[here]]
                return bit

            gini = np.full((len(g), order.shape[1]), np.inf)
            for i in range(order.shape[1]):
                left = on_left(order[:, i], at[:, i])
                w, p = np.add.reduceat(weight * left, first), np.add.reduceat(positives * left, first)
                found = np.zeros(len(g))
                for a, b in ((w, p), (total[g] - w, positive[g] - p)):
                    found += np.divide(b * (a - b), a, out=np.zeros(len(g)), where=a > 0)
                gini[:, i] = np.where(drawn_varies[:, i], found, np.inf)
            best = np.argmin(gini, axis=1)
            feature[g], threshold[g] = order[np.arange(len(g)), best], at[np.arange(len(g)), best]
        leaf = feature < 0
        for p in np.split(np.arange(len(node)), range(some, len(node), some)):
            ends = pa.array(np.arange(0, many * len(p) + 1, max(1, many), dtype=np.int32))
            ranges = [pa.ListArray.from_arrays(ends, pa.array(layout.unpack(v[:, p], m[:, p]).ravel())) for v, m in ((low, every), (high, any_))]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(np.full(len(p), tree, np.int32)), "node": pa.array(node[p]), "depth": pa.array(np.full(len(p), depth, np.int32)), "n": pa.array(n[p].astype(np.int64)), "weight": pa.array(total[p]), "positive": pa.array(positive[p]),
                "low": ranges[0], "high": ranges[1], "feature": pa.array(feature[p], mask=leaf[p]), "threshold": pa.array(threshold[p], mask=leaf[p]),
            })
        if not len(g):
            break
        to, n_left = parted(~on_left(feature[g], threshold[g]), first, n_g)
        back = np.empty(len(to), np.int64)
        back[to] = row
        numbers, words, label, weight = numbers[:, back], words[:, back], label[back], weight[back]
        node, start = (2 * node[g][:, None] + [1, 2]).ravel(), np.stack([first, first + n_left], axis=1).ravel()
        depth += 1


def _grow_below(rows: pa.Table, bases: tuple[int, int], drawn: int, min_rows: int, deepest: int) -> pa.Table:
    """All nodes of the tree below one node, itself included, from the rows of that node."""
    x = matrix(rows["x"].combine_chunks(), rows.num_rows)
    layout = Layout.of(((x == 0) | (x == 1)).all(axis=0))
    numbers, words = layout.pack(x)
    label, weight = rows["label"].to_numpy(), rows["weight"].to_numpy()
    return pa.Table.from_batches(_grown(layout, numbers, words, label, weight, rows["tree"][0].as_py(), rows["node"][0].as_py(), bases, drawn, min_rows, deepest))


def _leaves_below(rows: pa.Table, nodes: pa.Table) -> pa.Table:
    """``__row, leaf``: the value of the leaf that each row comes to from the uppermost of ``nodes``."""
    if not rows.num_rows:
        return pa.table({"__row": pa.array([], pa.int64()), "leaf": pa.array([], pa.float64())})
    x = matrix(rows["__x"].combine_chunks(), rows.num_rows)
    nodes = nodes.sort_by("node")
    ids, feature = nodes["node"].to_numpy(), nodes["feature"].fill_null(-1).to_numpy()
    threshold, value = nodes["threshold"].fill_null(0.0).to_numpy(), nodes["value"].to_numpy()
    below = np.searchsorted(ids, 2 * ids + 1)  # the right child's number is the next one
    return pa.table({"__row": rows["__row"].combine_chunks(), "leaf": pa.array(leaf_values(feature, threshold, value, below, x))})


@dataclass(frozen=True)
class ExtraTrees:
    """Estimator over ``features`` (vector), ``label`` (0 or 1) and ``weight``; ``min_rows`` is the least to split."""

    num_trees: int = 100
    max_depth: int = 30
    min_rows: int = 2
    seed: int = 42

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
        width = rows.select(F.size("x").alias("n")).first()
        if width is None:
            raise ValueError("no rows to grow trees on")
        many, drawn = width["n"], max(1, int(width["n"] ** 0.5))
        deepest, few = min(self.max_depth, DEEPEST), _subtree_rows(many)
        rows = stored(rows)
        values = packed.few_values(rows, many, 2)
        layout = Layout.of([v is not None and np.isin(v, (0.0, 1.0)).all() for v in values])
        if rows.count() * layout.row_bytes <= packed.PACKED_BYTES:
            return self._model(self._grown_whole(rows, layout, drawn, deepest))
        trees = F.explode(F.sequence(F.lit(0), F.lit(self.num_trees - 1)))
        open_ = rows.select("*", trees.alias("tree"), F.lit(0).cast("bigint").alias("node"))
        done, small = [], []
        for depth in range(deepest + 1):
            x = [F.col("x")[f] for f in range(many)]
            sums = [
                F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("label")).alias("positive"),
                F.min("label").alias("__least"), F.max("label").alias("__most"),
                F.array(*map(F.min, x)).alias("low"), F.array(*map(F.max, x)).alias("high"),
            ]
            if depth:
                found = open_.groupBy("tree", "node").agg(*sums)
            else:  # the roots of all trees hold the same rows
                found = rows.agg(*sums).select(trees.alias("tree"), F.lit(0).cast("bigint").alias("node"), "*")
            grows = (F.col("__least") < F.col("__most")) & (F.col("n") >= self.min_rows) & F.lit(depth < deepest)
            nodes = stored(found.withColumn("draws", F.when(grows, self._draws(many, drawn)).otherwise(F.array().cast("array<struct<f:int,at:double>>"))).drop("__least", "__most"))
            apart = (F.size("draws") > 0) & (F.col("n") <= few)
            growing = nodes.where((F.size("draws") > 0) & ~apart)
            counts = nodes.agg(F.count_if(apart).alias("apart"), F.count_if((F.size("draws") > 0) & ~apart).alias("growing")).first()
            if counts["apart"]:
                small.append((open_.join(_marked(nodes.where(apart).select("tree", "node"), counts["apart"]), ["tree", "node"]).select("tree", "node", "x", "label", "weight"), counts["apart"]))
                nodes = nodes.where(~apart)
            many_growing = counts["growing"]
            if not many_growing:
                done.append(nodes.select("tree", "node", F.lit(depth).alias("depth"), "n", "weight", "positive", "low", "high", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold")))
                break
            splits = stored(self._splits(open_, _marked(growing, many_growing), drawn))
            done.append(nodes.join(splits, ["tree", "node"], "left").select("tree", "node", F.lit(depth).alias("depth"), "n", "weight", "positive", "low", "high", "feature", "threshold"))
            splits = _marked(splits, many_growing)
            side = F.when(F.col("x")[F.col("feature")] <= F.col("threshold"), 1).otherwise(2)
            open_ = stored(open_.join(splits, ["tree", "node"]).select("x", "label", "weight", "tree", (2 * F.col("node") + side).alias("node")))
        if small:
            done.append(self._grown_apart(small, drawn, deepest))
        table = done[0]
        for more in done[1:]:
            table = table.unionByName(more)
        return self._model(table)

    def _model(self, nodes: DataFrame) -> ExtraTreesModel:
        return ExtraTreesModel(stored(nodes.withColumn("value", F.col("positive") / F.col("weight"))), self.num_trees)

    def _bases(self, spark: SparkSession) -> tuple[int, int]:
        return tuple(spark.range(1).select(*[F.xxhash64(F.lit(f"{what}{self.seed}")) for what in ("feature", "threshold")]).first())

    def _grown_whole(self, rows: DataFrame, layout: Layout, drawn: int, deepest: int) -> DataFrame:
        """All nodes, each tree from all rows in a task of its own."""
        bases, min_rows = self._bases(rows.sparkSession), self.min_rows

        def grow(tree, records):
            yield from _grown(layout, *layout.read(records), tree, 0, bases, drawn, min_rows, deepest)

        return packed.by_tree(packed.blocks(rows, layout.body), self.num_trees, grow, NODES)

    def _grown_apart(self, small: list[tuple[DataFrame, int]], drawn: int, deepest: int) -> DataFrame:
        """Nodes below those that have left the levels, from their rows; ``small`` has for each level the rows and the number of nodes."""
        rows, groups, min_rows = small[0][0], sum(n for _, n in small), self.min_rows
        for more, _ in small[1:]:
            rows = rows.unionByName(more)
        bases = self._bases(rows.sparkSession)
        # A number of its own, as adaptive execution would put many small groups in one task.
        dealt = rows.repartition(min(groups, BROADCAST_ROWS // 100), "tree", "node")
        return dealt.groupBy("tree", "node").applyInArrow(lambda t: _grow_below(t, bases, drawn, min_rows, deepest), NODES)

    def _uniform(self, what: str, f) -> F.Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(f"{what}{self.seed}"), "tree", "node", f), 11) / F.lit(2.0**53)

    def _draws(self, many: int, drawn: int) -> F.Column:
        """Features of the node that vary, in an order drawn by hash, with a threshold from the least value up to below the greatest."""
        varying = F.filter(F.sequence(F.lit(0), F.lit(many - 1)), lambda f: F.get("low", f) < F.get("high", f))
        order = F.array_sort(F.transform(varying, lambda f: F.struct(self._uniform("feature", f).alias("u"), f.alias("f"))))

        def threshold(f):
            at = F.get("low", f) + self._uniform("threshold", f) * (F.get("high", f) - F.get("low", f))
            return F.struct(f.alias("f"), F.when(at < F.get("high", f), at).otherwise(F.get("low", f)).alias("at"))

        return F.transform(F.slice(order, 1, drawn), lambda o: threshold(o["f"]))

    def _splits(self, open_: DataFrame, nodes: DataFrame, drawn: int) -> DataFrame:
        """(tree, node, feature, threshold): of the node's draws the one with the least Gini impurity; the first on ties."""
        sums = []
        asked = nodes.select("tree", "node", "draws")
        for i in range(drawn):
            here = F.get("draws", F.lit(i))
            left = F.get("x", here["f"]) <= here["at"]
            sums += [F.sum(F.when(left, F.col("weight"))).alias(f"w{i}"), F.sum(F.when(left, F.col("weight") * F.col("label"))).alias(f"p{i}")]
        sides = open_.join(asked, ["tree", "node"]).groupBy("tree", "node").agg(*sums)
        impurity = lambda w, p: F.when(w > 0, p * (w - p) / w).otherwise(0.0)
        gini = [
            F.when(F.col(f"w{i}").isNotNull(), F.struct((impurity(F.col(f"w{i}"), F.col(f"p{i}")) + impurity(F.col("weight") - F.col(f"w{i}"), F.col("positive") - F.col(f"p{i}"))).alias("g"), F.lit(i).alias("i")))
            for i in range(drawn)
        ]
        best = F.array_min(F.array_compact(F.array(*gini)))
        chosen = nodes.select("tree", "node", "weight", "positive", "draws").join(sides, ["tree", "node"]).select("tree", "node", F.get("draws", best["i"]).alias("d"))
        return chosen.select("tree", "node", F.col("d.f").alias("feature"), F.col("d.at").alias("threshold"))


@dataclass(frozen=True)
class ExtraTreesModel:
    """``nodes``: tree, node, depth, n, weight, positive, low, high, feature, threshold (null in a leaf), value."""

    nodes: DataFrame
    num_trees: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``: the mean of the trees' leaf values. Rows pass tasks that hold some trees; where a tree is too
        large for that, they go down all trees a level at a time, by joins with the nodes."""
        rows = stored(df.withColumn("__row", F.monotonically_increasing_id()))
        scores = packed.score_trees(self.nodes, rows.select("__row", vector_to_array("features").alias("__x")), self.num_trees)
        if scores is None:
            scores = self._scores_by_levels(rows)
        scores = stored(scores)  # those who scan the result many times do not walk the trees again
        both = array_to_vector(F.array(1 - F.col("__p"), F.col("__p")))
        return rows.join(scores, "__row").select(*[F.col(f"`{c}`") for c in df.columns], both.alias("probability"))

    def _scores_by_levels(self, rows: DataFrame) -> DataFrame:
        trees = F.explode(F.sequence(F.lit(0), F.lit(self.num_trees - 1)))
        at = rows.select("__row", vector_to_array("features").alias("__x"), trees.alias("tree"), F.lit(0).cast("bigint").alias("node"), F.lit(None).cast("double").alias("leaf"))
        width = at.select(F.size("__x").alias("n")).first()
        few = _subtree_rows(width["n"] if width else 1)
        top = self.nodes.where(F.col("n") > few).select("tree", "node", "depth", "feature", "threshold", "value")
        sizes = {r["depth"]: r["count"] for r in top.groupBy("depth").count().collect()}
        for depth in sorted(sizes):
            level = _marked(top.where(F.col("depth") == depth).drop("depth"), sizes[depth])
            x = F.get("__x", F.col("feature"))
            moved = 2 * F.col("node") + F.when(x <= F.col("threshold"), 1).otherwise(2)
            at = at.join(level, ["tree", "node"], "left").select(
                "__row", "__x", "tree", F.when(F.col("feature").isNotNull(), moved).otherwise(F.col("node")).alias("node"),
                F.coalesce("leaf", F.when(F.col("feature").isNull(), F.col("value"))).alias("leaf"),
            )
            if depth % STRIDE == STRIDE - 1:
                at = stored(at)
        if sizes:
            at = stored(at)
        leaves = self._leaves(at.where("leaf is null").withColumnRenamed("node", "root").drop("leaf"), few, len(sizes))
        if sizes:
            leaves = leaves.unionByName(at.where("leaf is not null").select("__row", "leaf"))
        return leaves.groupBy("__row").agg(F.avg("leaf").alias("__p"))

    def _leaves(self, at: DataFrame, few: int, levels: int) -> DataFrame:
        """``__row, leaf`` of rows that stand at the uppermost node (``root``) of at most ``few`` training rows: they meet what is below it, in chunks."""
        below = self.nodes.where(F.col("n") <= few).select("tree", "node", "depth", "feature", "threshold", "value")
        counts = stored(at.groupBy("tree", "root").agg(F.ceil(F.count(F.lit(1)) / few).cast("int").alias("chunks")))
        size = counts.agg(F.count(F.lit(1)).alias("roots"), F.coalesce(F.sum("chunks"), F.lit(1)).alias("chunks")).first()
        roots = _marked(counts, size["roots"])
        if levels:  # of the nodes on the way up from a node one is such a root
            up = F.transform(F.sequence(F.lit(0), F.least("depth", F.lit(levels))), lambda d: F.call_function("shiftright", F.col("node") + 1, F.col("depth") - d) - 1)
            below = below.withColumn("root", F.explode(up))
        else:
            below = below.withColumn("root", F.lit(0).cast("bigint"))
        below = below.join(roots, ["tree", "root"]).select("tree", "root", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "feature", "threshold", "value")
        dealt = at.join(roots, ["tree", "root"]).select("tree", "root", F.pmod(F.xxhash64("__row"), F.col("chunks")).cast("int").alias("chunk"), "__row", "__x")
        tasks, keys = min(size["chunks"], BROADCAST_ROWS // 100), ["tree", "root", "chunk"]
        left, right = (d.repartition(tasks, *keys).groupBy(*keys) for d in (dealt, below))
        return left.cogroup(right).applyInArrow(_leaves_below, "__row bigint, leaf double")

    def save(self, path: str) -> None:
        self.nodes.withColumn("num_trees", F.lit(self.num_trees)).write.parquet(path)

    @staticmethod
    def load(path: str) -> ExtraTreesModel:
        table = SparkSession.active().read.parquet(path)
        return ExtraTreesModel(table.drop("num_trees"), table.first()["num_trees"])
