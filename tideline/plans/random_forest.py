"""Random forests: Spark's own on few rows, and above that the same kind of trees grown one in a task from binned rows.

Spark grows all trees side by side and keeps them on the driver; open nodes go in groups of a fixed size of statistics, and
each group passes over all rows of all trees, so both passes and their cost grow with the rows. Here a task holds all rows, a byte for
each feature, and grows a tree alone: Poisson bootstrap, features drawn at every node, the split with the greatest Gini gain
between bins, and siblings of one class united at the end, as Spark does. Nodes are a table that never comes to the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans import packed
from tideline.plans.extra_trees import ExtraTreesModel
from tideline.plans.packed import matrix, parted
from tideline.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows up to which Spark's own forest is grown.
SPARK_ROWS = 10_000
#: Nodes whose bins are counted at once.
COUNTED_NODES = 4_096
#: Values of a feature, at even ranks of all rows of a weight, from which its bins are made. Spark draws 10 000 rows by chance.
RANKS = 2_000
#: The most weights that rows have, where bins are made here.
WEIGHTS = 16
NODES = "tree int, node bigint, depth int, n bigint, weight double, positive double, feature int, threshold double"


def _grown(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, splits: list[np.ndarray], tree: int, seed: int, drawn: int, deepest: int, min_rows: int) -> list[dict[str, np.ndarray]]:
    """Levels of one tree. ``codes`` are places among a feature's ``splits``; a row is left of a split if its place is at most that of the split."""
    rng = np.random.default_rng([seed, tree])
    times = rng.poisson(1.0, len(codes))
    kept = np.flatnonzero(times)
    codes, label, times = codes[kept], label[kept], times[kept]
    weight = weight[kept] * times
    many, wide = codes.shape[1], max(map(len, splits)) + 1
    at_most = np.full((many, max(1, wide - 1)), np.inf)
    for f, s in enumerate(splits):
        at_most[f, : len(s)] = s
    node, start, levels = np.array([0], np.int64), np.array([0]) if len(codes) else np.array([], np.int64), []
    if not len(codes):
        return []
    for depth in range(deepest + 1):
        rows_of = np.diff(np.append(start, len(label)))
        n, total, positive = np.add.reduceat(times, start), np.add.reduceat(weight, start), np.add.reduceat(weight * label, start)
        mass = _mass(total, positive)
        feature, split = np.full(len(node), -1, np.int32), np.zeros(len(node), np.int64)
        open_ = np.flatnonzero((2 * mass > 1e-15 * total) & (n >= 2 * min_rows)) if depth < deepest else np.array([], np.int64)
        for some in np.split(open_, range(COUNTED_NODES, len(open_), COUNTED_NODES)):
            if not len(some):
                continue
            size = rows_of[some]
            slot = np.repeat(np.arange(len(some)), size)
            rows = np.arange(size.sum()) + np.repeat(start[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            if many > drawn:
                asked = np.argpartition(rng.random((len(some), many)), drawn - 1, axis=1)[:, :drawn]
            else:
                asked = np.broadcast_to(np.arange(many), (len(some), many))
            w, p, c, flat = weight[rows], (weight * label)[rows] if len(some) == len(node) else weight[rows] * label[rows], times[rows], rows * many
            best = np.zeros(len(some))
            for i in range(asked.shape[1]):
                f = asked[:, i]
                key = slot * wide + codes.ravel()[flat + f[slot]]
                lw, lp, lc = (np.bincount(key, weights=v, minlength=len(some) * wide).reshape(-1, wide).cumsum(axis=1)[:, :-1] for v in (w, p, c))
                gain = _mass(total[some], positive[some])[:, None] - _mass(lw, lp) - _mass(total[some][:, None] - lw, positive[some][:, None] - lp)
                gain[(lc < min_rows) | (n[some][:, None] - lc < min_rows)] = 0.0
                at = np.argmax(gain, axis=1)
                found = 2 * gain[np.arange(len(some)), at] / total[some]
                better = found > np.maximum(best, 1e-15)
                best[better] = found[better]
                feature[some[better]], split[some[better]] = f[better], at[better]
        g = np.flatnonzero(feature >= 0)
        levels.append({"node": node, "n": n, "weight": total, "positive": positive, "feature": feature, "threshold": np.where(feature >= 0, at_most[feature, split], 0.0)})
        if not len(g):
            break
        if len(g) < len(node):
            kept = np.flatnonzero(np.repeat(feature >= 0, rows_of))
            codes, label, weight, times = codes[kept], label[kept], weight[kept], times[kept]
        size = rows_of[g]
        slot, first = np.repeat(np.arange(len(g)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
        right = codes[np.arange(len(codes)), feature[g][slot]] > split[g][slot]
        to, left = parted(right, first, size)
        back = np.empty(len(to), np.int64)
        back[to] = np.arange(len(to))
        codes, label, weight, times = codes[back], label[back], weight[back], times[back]
        node, start = (2 * node[g][:, None] + [1, 2]).ravel(), np.stack([first, first + left], axis=1).ravel()
    return levels


def _mass(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Half the Gini impurity times the weight."""
    return np.divide(positive * (weight - positive), weight, out=np.zeros(np.shape(weight)), where=weight > 0)


def _united(levels: list[dict[str, np.ndarray]]) -> None:
    """Siblings that are leaves of one class become one leaf, from below; what is below a leaf goes."""
    below: dict[str, np.ndarray] | None = None
    for level in reversed(levels):
        level["class"] = 2 * level["positive"] > level["weight"]
        g = np.flatnonzero(level["feature"] >= 0)
        if below is not None and len(g):
            pair = (below["feature"] < 0).reshape(-1, 2).all(axis=1) & (below["class"][::2] == below["class"][1::2])
            level["inner"] = ~pair
            level["feature"][g[pair]] = -1
        below = level
    there = np.ones(1, bool)
    for level in levels:
        inner = level.pop("inner", np.zeros(0, bool))
        grown = np.zeros(len(there), bool)
        g = level["grown"]
        grown[g] = inner
        level["there"] = there
        there = np.repeat((there & grown)[g], 2)


def _tree(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, splits: list[np.ndarray], tree: int, *how) -> Iterator[pa.RecordBatch]:
    levels = _grown(codes, label, weight, splits, tree, *how)
    for level in levels:
        level["grown"] = np.flatnonzero(level["feature"] >= 0)
    _united(levels)
    for depth, level in enumerate(levels):
        keep = np.flatnonzero(level["there"])
        if len(keep):
            leaf = level["feature"][keep] < 0
            same = {"tree": np.full(len(keep), tree, np.int32), "node": level["node"][keep], "depth": np.full(len(keep), depth, np.int32), "n": level["n"][keep].astype(np.int64)}
            yield pa.RecordBatch.from_pydict({
                **{k: pa.array(v) for k, v in same.items()}, "weight": pa.array(level["weight"][keep]), "positive": pa.array(level["positive"][keep]),
                "feature": pa.array(level["feature"][keep], mask=leaf), "threshold": pa.array(level["threshold"][keep], mask=leaf),
            })


def _stride_splits(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` places between values, as Spark sets them: one each time that about an equal share of the weight has been passed."""
    distinct, at = np.unique(values, return_inverse=True)
    middle, upto = (distinct[1:] + distinct[:-1]) / 2, np.cumsum(np.bincount(at, weights=weights))
    if len(middle) <= most:
        return middle
    out, stride = [], upto[-1] / (most + 1)
    for place, passed, after in zip(middle, upto[:-1], upto[1:], strict=True):
        aim = stride * (len(out) + 1)
        if abs(passed - aim) < abs(after - aim):
            out.append(place)
    return np.array(out)


def _splits(rows: DataFrame, many: int, bins: int) -> list[np.ndarray]:
    """Places that part a feature into at most ``bins`` bins: between all values where these are few, else by the values at even ranks of each weight."""
    few = packed.few_values(rows, many, bins)
    wide = [f for f in range(many) if few[f] is None]
    ranks = F.array(*[F.lit((k + 0.5) / RANKS) for k in range(RANKS)])
    found = rows.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col("x")[f], ranks, 10 * RANKS).alias(f"v{f}") for f in wide]).collect() if wide else []
    heavy = np.repeat([r["weight"] * r["n"] / RANKS for r in found], RANKS)
    values = lambda f: np.concatenate([r[f"v{f}"] for r in found])
    return [_stride_splits(values(f), heavy, bins - 1) if few[f] is None else (few[f][1:] + few[f][:-1]) / 2 for f in range(many)]


class RandomForest(RandomForestClassifier):
    """Spark's random forest of two classes; above ``SPARK_ROWS`` rows its trees are grown here, and the model is a table of nodes."""

    def _fit(self, dataset: DataFrame):
        count = dataset.count()
        if count <= SPARK_ROWS:
            return super()._fit(dataset)
        weight = F.col(self.getWeightCol()) if self.isSet("weightCol") and self.getWeightCol() else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("label"), weight.cast("double").alias("weight"))
        many = rows.select(F.size("x").alias("n")).first()["n"]
        odd = F.max(F.col("label").isin(0.0, 1.0).eqNullSafe(F.lit(False))), F.min("weight"), F.sum("label")
        other, least, positive = rows.agg(*odd).first()
        as_here = self.getFeatureSubsetStrategy() == "sqrt" and self.getImpurity() == "gini" and self.getBootstrap() and self.getSubsamplingRate() == 1.0
        as_here &= self.getMinInfoGain() == 0 and self.getMinWeightFractionPerNode() == 0 and self.getNumTrees() > 1 and self.getMaxBins() <= 256 and not self.isDefined("thresholds")
        as_here &= rows.select("weight").distinct().limit(WEIGHTS + 1).count() <= WEIGHTS
        if not as_here or other or least <= 0 or not 0 < positive < count or count * (many + 16) > packed.PACKED_BYTES:
            return super()._fit(dataset)
        rows = stored(rows)
        splits = _splits(rows, many, self.getMaxBins())
        how = self.getSeed(), int(np.ceil(np.sqrt(many))), self.getMaxDepth(), self.getMinInstancesPerNode()

        def body(batch: pa.RecordBatch) -> bytes:
            x = matrix(batch.column("x"), batch.num_rows)
            codes = np.stack([np.searchsorted(s, x[:, f]) for f, s in enumerate(splits)], axis=1).astype(np.uint8)
            return b"".join((*(batch.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("label", "weight")), codes.tobytes()))

        def grow(tree, records):
            labels, weights, codes = zip(*((np.frombuffer(b, np.float64, n), np.frombuffer(b, np.float64, n, 8 * n), np.frombuffer(b, np.uint8, offset=16 * n).reshape(n, -1)) for n, b in records), strict=True)
            records.clear()
            yield from _tree(np.concatenate(codes), np.concatenate(labels), np.concatenate(weights), splits, tree, *how)

        nodes = packed.by_tree(packed.blocks(rows, body), self.getNumTrees(), grow, NODES)
        return ExtraTreesModel(stored(nodes.withColumn("value", F.col("positive") / F.col("weight"))), self.getNumTrees())
