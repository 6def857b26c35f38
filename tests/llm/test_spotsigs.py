import hashlib
import random
from itertools import combinations

import pytest

from tideline.llm import spotsigs
from tideline.llm.queries import QUERIES


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        a, b, c = (spotsigs.chains(t) for t in (text, new, following))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), spotsigs.written(a), spotsigs.written(b), near(a, b), near(a, c)))
    return sorted(out, key=str)


def test_chains_follow_common_words():
    h = lambda x: __import__("xxhash").xxh32_intdigest(x)
    assert spotsigs.chains("At Rally: the Big, red and fast car") == {h("the big red fast"), h("and fast car")}
    assert spotsigs.chains("one two three four") == {h("one two three"), h("two three four")}
    assert spotsigs.chains("the of") == {h("the of"), h("of")} and spotsigs.chains(None) == spotsigs.chains(" .") == set()
    assert spotsigs.chains("word the") == {h("word the")}


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_equals_brute_force(spark, documents, parts):
    rows = [(i * 7 % 40, f"the é{i} of word{i % 5} and more {i // 3} " * (i % 4)) for i in range(40)]
    rows += [(None, "the first of none"), (None, None), (3, None), (3, "the third"), (3, "the third"), (80, "x y " * 100_000)]
    got = sorted([tuple(r) for r in spotsigs.with_next(documents(rows), parts=parts).collect()], key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("make", [lambda i: (1 << 60) + 3 * i, lambda i: f"id-{i * 7919 % 1000}é", lambda i: -i])
def test_ids_of_any_kind_and_size(spark, make):
    rows = [(make(i), f"the text {i} and its words") for i in range(500)]
    kind = "string" if isinstance(rows[0][0], str) else "bigint"
    table = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = [tuple(r) for r in spotsigs.with_next(table, parts=40).collect()]
    full = []
    for k, (i, text) in enumerate(ordered := sorted(rows)):
        following = ordered[(k + 1) % len(ordered)][1]
        full.append((i, len(text), hashlib.sha256(spotsigs.edited(text, following).encode()).hexdigest()))
    assert len(got) == 500 and sorted(r[:3] for r in got) == full


def test_small_tables(spark, documents):
    assert spotsigs.with_next(documents([])).collect() == []
    for rows in ([(1, "the one and only")], [(None, None)], [(2, None), (1, "the big red car")]):
        assert sorted([tuple(r) for r in spotsigs.with_next(documents(rows)).collect()], key=str) == plain(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in QUERIES["op6_spotsigs"](spark, sf).collect()], key=str) == plain(rows)


def test_near_pairs_are_complete(spark, documents):
    rng, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{(i // 6) * 50 + k}" for k in range(30)]
        for _ in range(i % 6):
            words[rng.randrange(30)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(f"the {w}" for w in words[: 30 - i % 3])))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (None, rows[0][1])]
    members, pairs = spotsigs.near_pairs(documents(rows), least=0.6)
    of = {}
    for r in members.collect():
        of.setdefault(r.set_id, set()).add(r.id)
    assert sum(map(len, of.values())) == len(rows)
    texts = dict(rows)
    sets = {s: spotsigs.chains(texts[next(iter(ids))]) for s, ids in of.items()}
    want = {frozenset((a, b)) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = pairs.collect()
    assert {frozenset((r.a, r.b)) for r in got} == want and len(got) == len(want) and want
