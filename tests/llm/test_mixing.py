import random
from collections import Counter
from fractions import Fraction

import pytest

from tideline.llm import mixing
from tideline.llm.queries import QUERIES


def plain(counts, blocks):
    """Slot by slot over all blocks: earliest deadline first; shares are dealt anew when a source ends."""
    left, out, slot = dict(blocks), {}, 0
    done = Counter()
    while any(left.values()):
        active = {s: counts[s] for s in left if left[s] and counts.get(s)} or {s: 1 for s in left if left[s]}
        period, start, given = sum(active.values()), slot, Counter()
        while all(left[s] for s in active):
            t = slot - start
            ready = [(-(-(given[s] + 1) * period // q), s) for s, q in active.items() if given[s] * period // q <= t]
            s = min(ready)[1]
            for x, q in active.items():  # less than one block from the exact share at any time
                assert abs(given[x] - Fraction(t * q, period)) < 1
            out[s, done[s]] = slot
            given[s] += 1
            done[s] += 1
            left[s] -= 1
            slot += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_equals_the_slot_by_slot_schedule(seed):
    rng = random.Random(seed)
    blocks = {f"s{i}": rng.randrange(60) for i in range(rng.randrange(1, 7))}
    # Short periods, which repeat, and exact weights, whose period no source outlasts.
    weights = {s: rng.randrange(1, 12) if seed % 2 else rng.random() + 0.01 for s in blocks}
    counts = mixing.slot_counts(weights)
    assert all(Fraction(counts[a]) * Fraction(weights[b]) == Fraction(counts[b]) * Fraction(weights[a]) for a in blocks for b in blocks)
    if seed == 5:
        counts.pop("s0")
    got = {}
    for s, found in mixing.phases(counts, blocks).items():
        for k in range(blocks[s]):
            first, _, start, q, period, slots = [p for p in found if p[0] <= k][-1]
            got[s, k] = start + (k - first) // q * period + int(slots[(k - first) % q])
    assert got == plain(counts, blocks)


def test_query_places_every_document_once_and_in_time(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_mixing"](spark, sf).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.source for r in rows} == docs and len(rows) == len(docs)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    slots = {r.slot: (r.source, r.block) for r in rows}
    assert sorted(slots) == list(range(len(slots))) and len(set(slots.values())) == len(slots)
    sizes = Counter(docs.values())
    counts = mixing.slot_counts({s: n**mixing.TEMPERATURE for s, n in sizes.items()})
    want = plain(counts, {s: -(-n // mixing.BLOCK) for s, n in sizes.items()})
    assert {v: k for k, v in slots.items()} == want
    assert Counter((r.source, r.block) for r in rows).most_common(1)[0][1] == mixing.BLOCK


def test_large_sources_nulls_repeats_and_given_weights(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    rows = [(i, "t", None, "big") for i in range(90)] + [(i, None, None, "small") for i in range(90, 100)] + [(None, "x", None, None)] * 3 + [(5, "t", None, "big")]
    docs = documents(rows)
    out = mixing.mix(docs, {"big": 3, "small": 1, "gone": 5}, block=2).collect()
    assert len(out) == len(rows)
    places = [(r.mix.slot, r.mix.place) for r in out]
    assert len(set(places)) == len(places)
    first = [r.source for r in sorted(out, key=lambda r: (r.mix.slot, r.mix.place))][:32]
    assert 6 <= first.count("small") <= 10 and max(r.mix.slot for r in out if r.source) < min(r.mix.slot for r in out if not r.source)
    assert mixing.mix(documents([])).collect() == []
    staged = mixing.stage(docs)
    assert staged.columns == [*docs.columns, "mix_slot", "mix_place"] and staged.count() == len(rows)


@pytest.mark.parametrize("weights", [{"hot": 0.9, **{f"s{i}": 0.0005 for i in range(200)}}, {"hot": 20_000**0.7, **{f"s{i}": 50**0.7 for i in range(20)}}])
def test_shares_stay_within_a_block_of_the_given_weights(spark, documents, weights):
    rows = [(i, None, None, "hot") for i in range(2500)] + [(j, None, None, s) for j, s in enumerate([s for s in weights if s != "hot"] * 8)]
    total = sum(Fraction(w) for w in weights.values())
    out = sorted((r.mix.slot, r.source) for r in mixing.mix(documents(rows), weights, block=1).where("mix.phase = 0").collect())
    given = Counter()
    assert len(out) > 400
    for t, (slot, source) in enumerate(out, 1):
        given[source] += 1
        assert slot == t - 1 and all(abs(given[s] - t * Fraction(w) / total) < 1 for s, w in weights.items())
