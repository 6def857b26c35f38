import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tideline.llm import repeats
from tideline.llm.queries import QUERIES


def plain(rows, span):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i] += 1
                gone[i + span] -= 1 if i + span < len(d) + 1 else 0
        gone = np.cumsum(gone)[: len(d)] > 0
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc, len(d), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum() if len(d) else 0), hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    passage, base = text(60), text(300)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = text(rng.randrange(200)) + passage[rng.randrange(10) : 60 - rng.randrange(10)] + text(rng.randrange(200))
        elif kind == 1:
            t = base
        elif kind == 2:
            at = rng.randrange(300)
            t = base[:at] + "X" + base[at + 1 :]
        elif kind == 3:
            t = "ab" * rng.randrange(100)
        elif kind == 4:
            t = base[rng.randrange(100) : 100 + rng.randrange(200)]
        else:
            t = text(rng.randrange(60))
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("seed,gram,group,hot", [(1, 8, 8192, 64), (2, 20, 3, 64), (3, 8, 5, 1)])
def test_equals_brute_force(spark, documents, monkeypatch, seed, gram, group, hot):
    """Small groups in one induction, groups above the limit, and anchors split as hot."""
    monkeypatch.setattr(repeats, "HOT_MEMBERS", hot)
    monkeypatch.setattr(repeats, "PIECE", 500)
    rows = made(seed)
    assert found(repeats.remove_repeats(documents(rows), span=40, gram=gram, group=group)) == sorted(plain(rows, 40), key=str)


def test_nulls_repeated_rows_long_texts(spark, documents):
    long = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(3000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long[:39]), (None, "q" * 100), (5, "q" * 40), (6, "p" * 2000)]
    assert found(repeats.remove_repeats(documents(rows), span=40, gram=8)) == sorted(plain(rows, 40), key=str)
    assert repeats.remove_repeats(documents([])).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op5_repeats"](spark, sf).collect()]
    assert sorted(got) == sorted(plain(rows, 400)) and any(r[2] for r in got)


def test_induction_equals_direct_comparison():
    rng = random.Random(5)
    rows = sorted((rng.randrange(4), bytes(rng.choices(b"ab", k=rng.randrange(12, 21))), bytes(rng.choices(b"ab", k=rng.randrange(10)))) for _ in range(200))
    low, high = repeats.induce(np.array([r[0] for r in rows]), [r[2] for r in rows], [r[1] for r in rows], 20, 9)
    for i, (g, right, left) in enumerate(rows):
        want = [s for s in range(len(left) + 1) if 20 - s <= len(right) and any(j != i and h == g and len(x) >= s and (x[len(x) - s :] + r)[:20] == (left[len(left) - s :] + right)[:20] for j, (h, r, x) in enumerate(rows))]
        assert (low[i], high[i]) == ((min(want), max(want)) if want else (-1, -1))


@pytest.mark.parametrize("group", [3, 8192])
def test_unique_text_around_runs_stays(spark, documents, group):
    """Several places of one anchor in a window do not make the window a repeated one."""
    rng = random.Random(7)
    text = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    rows = [(i, text(120) + ("-" * 70, "=+" * 35)[i % 2] + text(120)) for i in range(16)]
    got = found(repeats.remove_repeats(documents(rows), span=40, gram=8, group=group))
    assert got == sorted(plain(rows, 40), key=str) and all(70 <= r[2] < 80 for r in got)


def test_planted_passages_of_over_50_words(spark, tmp_path):
    """Passages of 51 to 120 words, below and above 400 bytes, in many files: what is removed is what the contract says, byte for byte.

    A passage below SPAN bytes stays, however often it stands in other documents; one of SPAN bytes or more goes.
    """
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    passages = [" ".join(word(rng.choice(size)) for _ in range(rng.randrange(51, 121))) for size in ((2, 3), (4, 5, 6), (7, 8)) for _ in range(8)]
    rows, holds = [], {}
    for i in range(600):
        text = " ".join(word(rng.randrange(2, 9)) for _ in range(rng.randrange(20, 200)))
        if i % 3 == 0:
            holds[i] = rng.randrange(len(passages))
            text = f"{text} {passages[holds[i]]} {word(5)} {word(9)}"
        rows.append((i, text))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(50).write.parquet(str(tmp_path / "documents.parquet"))
    with_parts = spark.read.parquet(str(tmp_path / "documents.parquet")).repartition(211)
    got = found(repeats.remove_repeats(with_parts))
    assert got == sorted(plain(rows, repeats.SPAN), key=str)
    removed = {r[0]: r[2] for r in got}
    assert not any(removed[i] for i in range(600) if i not in holds)  # clean documents are left alone
    long_, short = ([i for i in holds if (len(passages[holds[i]]) >= repeats.SPAN) == want] for want in (True, False))
    assert len(long_) > 50 and len(short) > 30
    assert all(removed[i] >= len(passages[holds[i]]) for i in long_) and not any(removed[i] for i in short if len(passages[holds[i]]) + 2 < repeats.SPAN)


def test_rows_of_a_large_group_do_not_meet_in_one_task(spark, documents, monkeypatch, tmp_path):
    """One passage in 400 texts: its differing contexts are dealt over the tasks, small groups still meet; same bytes as brute force."""
    rng, plainly, folder = random.Random(13), repeats._shared_shifts, str(tmp_path)
    text = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    passage, pair = text(60), text(60)
    rows = [(i, text(80) + (pair if i % 200 == 0 else passage) + text(80)) for i in range(400)]

    def counted(span, gram, limit):
        inner = plainly(span, gram, limit)

        def run(batches):
            import os
            import uuid

            held = [b for b in batches if b.num_rows]
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(" ".join(str(a) for b in held for a in b.column(0).to_pylist()))
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(repeats, "_shared_shifts", counted)
    monkeypatch.setattr(repeats, "HOT_MEMBERS", 10**9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(repeats.remove_repeats(documents(rows), span=40, gram=8, group=50))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(plain(rows, 40), key=str) and all(60 <= r[2] < 70 for r in got)
    tasks = [Counter(p.read_text().split()) for p in tmp_path.iterdir()]
    total = sum(tasks, Counter())
    large, small = ([a for a, n in total.items() if (n > 50) == want] for want in (True, False))
    assert large and small
    assert all(max(t[a] for t in tasks) < 0.6 * total[a] for a in large)
    assert all(sum(t[a] > 0 for t in tasks) == 1 for a in small)


def test_further_copies_of_a_hot_context_have_no_common_key(spark, documents):
    """Of 400 copies only two in each task go to their context's key; the others are dealt one by one."""
    rng = random.Random(17)
    copy = "".join(rng.choice("abcdefghijklmnop") for _ in range(200))
    docs = documents([(i, copy) for i in range(400)]).repartition(4).selectExpr("doc_id as id", "xxhash64(text) as th", "text")
    shape = "anchor bigint, salt int, context binary, id bigint, th bigint, at bigint"
    anchors = frozenset(r.anchor for r in docs.mapInArrow(repeats._sample_suffixes(40, 8, frozenset()), shape).select("anchor").distinct().collect())
    dealt = docs.mapInArrow(repeats._sample_suffixes(40, 8, anchors), shape).collect()
    keys = Counter((r.anchor, r.salt) for r in dealt if r.salt < 0)
    assert len({(r.id, r.at) for r in dealt}) == len(dealt) and sum(keys.values()) > 0.9 * len(dealt)
    assert max(keys.values()) == 1
