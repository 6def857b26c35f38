import math

import numpy as np
import pytest

from tideline.llm import pivots
from tideline.llm.queries import QUERIES

KINDS = "vec_id bigint, embedding array<double>, label int, component string, near int"


def plain(rows, least=pivots.LEAST):
    """Brute force: (id, links, component) of every row, in order."""
    n = len(rows)
    good = [x is not None and lab is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x) for _, x, lab, *_ in rows]
    links = [[] for _ in rows]
    groups = {}
    for k, (_, x, lab, *_) in enumerate(rows):
        if good[k]:
            groups.setdefault((lab, len(x)), []).append(k)
    for members in groups.values():
        x = np.array([rows[k][1] for k in members], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= least).tolist():
            if a != b:
                links[members[a]].append(members[b])
    root = list(range(n))
    for k in range(n):
        stack, seen = [k], {k}
        while stack:
            for m in links[stack.pop()]:
                if m not in seen:
                    seen.add(m)
                    stack.append(m)
        root[k] = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
    return [(r[0], len(ls), c) for r, ls, c in zip(rows, links, root, strict=True)]


def planted(rng, size=32, groups=40, spread=0.25):
    rows = []
    for g in range(groups):
        base = rng.normal(size=size)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.integers(1, 12))):
            noise = rng.normal(size=size)
            rows.append((len(rows), (base + noise / np.linalg.norm(noise) * rng.uniform(0, spread)).tolist(), g % 3, "x", 1))
    return rows + [(len(rows) + k, rng.normal(size=size).tolist(), k % 3, "x", 1) for k in range(600)]


def found(spark, rows, **options):
    return sorted((tuple(r[:3]) for r in pivots.near_vectors(spark.createDataFrame(rows, KINDS), **options).collect()), key=repr)


def recall(got, want):
    return sum(r[1] for r in got) / sum(r[1] for r in want)


def test_links_equal_brute_force_on_planted_groups(spark):
    rows = planted(np.random.default_rng(1))
    got, want = found(spark, rows), sorted(plain(rows), key=repr)
    assert got == want and sum(r[1] for r in want) > 1000


def test_recall_near_the_threshold_and_nothing_below_it(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(800):
        base, noise = rng.normal(size=64), rng.normal(size=64)
        base /= np.linalg.norm(base)
        noise -= base * (noise @ base)
        c = rng.uniform(0.93, 0.95)
        near = c * base + math.sqrt(1 - c * c) * noise / np.linalg.norm(noise)
        rows += [(2 * g, base.tolist(), 0, "x", 1), (2 * g + 1, near.tolist(), 0, "x", 1)]
    got, want = {r[0]: r[1] for r in found(spark, rows)}, {r[0]: r[1] for r in plain(rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())


@pytest.mark.parametrize("limit", [4, 16])
def test_large_group_of_near_copies_is_split(spark, monkeypatch, limit):
    monkeypatch.setattr(pivots, "LIST", limit)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(k, (base + rng.normal(size=16) * 0.05).tolist(), 1, "x", 1) for k in range(90)]
    rows += [(100 + k, rng.normal(size=16).tolist(), k % 2, "x", 1) for k in range(60)]
    rows += [(200 + k, rows[0][1], 1, "x", 1) for k in range(30)]
    assert found(spark, rows) == sorted(plain(rows), key=repr)


def test_odd_rows(spark):
    nan, inf, x = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [(1, x, 1, "a", 1), (2, [2.0, 4.0, 6.0], 1, None, None), (3, x, 2, "a", 1), (4, x, None, "a", 1), (5, None, 1, "a", 1), (6, [0.0, 0.0, 0.0], 1, "a", 1)]
    rows += [(7, [1.0, nan, 3.0], 1, "a", 1), (8, [1.0, inf, 3.0], 1, "a", 1), (9, [1.0, None, 3.0], 1, "a", 1), (10, [], 1, "a", 1), (11, [1.0, 2.0], 1, "a", 1)]
    rows += [(12, [1e300, 2e300, 3e300], 1, "a", 1), (13, [1e-310, 2e-310, 3e-310], 1, "a", 1), (None, x, 1, "a", 1), (None, [5.0], 1, "a", 1), (1, x, 1, "a", 1), (14, [-1.0, -2.0, -3.0], 1, "a", 1)]
    got = found(spark, rows)
    assert got == sorted(plain(rows), key=repr)
    out = pivots.near_vectors(spark.createDataFrame(rows, KINDS)).collect()
    assert all(r.kept == (r.id == r.component) for r in out)
    assert pivots.near_vectors(spark.createDataFrame([], KINDS)).collect() == []
    assert found(spark, [(k, None, None, None, None) for k in range(3)]) == [(k, 0, k) for k in range(3)]


@pytest.mark.parametrize("name", ["sf0.001", "sf0.1"])
def test_query_equals_brute_force(spark, name):
    sf = f"/root/testdata/{name}"
    rows = [tuple(r)[:3] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r[:3]) for r in QUERIES["op12_pivots"](spark, sf).collect())
    assert got == sorted(plain(rows))
