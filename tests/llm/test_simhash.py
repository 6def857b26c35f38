import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import simhash
from tideline.llm.queries import QUERIES
from tideline.operators.graph import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in fps}


def test_masks_cover_every_pair_within_the_radius():
    for level in range(4):
        masks = simhash.covering_masks(3, level)
        for r in (1, 2, 3):
            for bits in combinations(range(0, 64, 1 if r < 3 else 3), r):
                diff = sum(1 << b for b in bits)
                assert any(diff & m & (2**64 - 1) == 0 for m in masks)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = {(i, f"{fps[i]:016x}", c) for i, c in plain_components(fps).items()}
    got = QUERIES["op7_simhash"](spark, sf)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == want and got.count() == len(rows)


def test_nulls_empty_repeated_and_long_texts(spark, documents):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, long), (6, long), (None, "alone"), (7, "é b c D")]
    got = [(r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(documents(rows)).collect()]
    assert len(got) == len(rows)
    assert sorted((i, f) for i, f, _ in got if i is not None) == sorted((i, plain_fingerprint(t)) for i, t in rows if i is not None)
    assert {i: c for i, _, c in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, None: None, 7: 7}
    assert simhash.near_duplicates(documents([])).collect() == []
    kept = simhash.stage(documents(rows))
    assert kept.columns == documents([]).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7]


@pytest.mark.parametrize("limit", [2, 8])
def test_large_buckets_are_hashed_again_without_loss(spark, limit):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(150)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bucket=limit)
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_components({v: v & (2**64 - 1) for v in signed})
    groups = lambda m: sorted(sorted(x for x in signed if m.get(x, x) == r) for r in set(m.get(x, x) for x in signed))
    assert groups(got) == groups(want)


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(301)}
