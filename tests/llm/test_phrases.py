import random
import re
from collections import Counter

import numpy as np
import pytest

from tideline.llm import phrases

KINDS = "doc_id bigint, text string, lang string, word string, n int"


def plain(rows, least, keep):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            c = counts.setdefault(lang, Counter())
            for k in range(1, 5):
                c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, f in found.items():
            for k in range(2, len(g)):
                gone |= {g[s : s + k] for s in range(len(g) - k + 1) if 100 * f >= 80 * found[g[s : s + k]]}
        rows_ = []
        for g, a in found.items():
            score, _, left, right = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            if g not in gone:
                rows_.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(seed, docs=120, vocabulary=14):
    rng = random.Random(seed)
    words = ["a", "B", "Ça", "d\u00a0e", "x-1", "\x01", "it's"] + [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(docs):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ! "]) for _ in range(rng.randrange(60)))
        rows.append((body, ("en", "de", None)[rng.randrange(3)]))
    return rows + [("new york city hall " * 40, "en"), (None, "en"), ("", "fr"), ("one", "fr"), ("New York", None), ("new york, city", "und")] + [("same row again and again", "en")] * 9


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], KINDS)
    out = phrases.collocations(table, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("shard", "waiting", "piece", "least", "keep"), [(1 << 22, 1 << 20, 1 << 20, 5, 2000), (50, 30, 64, 3, 40)])
def test_equals_brute_force(spark, monkeypatch, shard, waiting, piece, least, keep):
    for name, value in (("SHARD", shard), ("WAITING", waiting), ("PIECE", piece), ("RANGE", 100)):
        monkeypatch.setattr(phrases, name, value)
    rows = texts(shard)
    want = plain(rows, least, keep)
    assert len(want) > 20 and found(spark, rows, least=least, keep=keep) == want


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "filter_of", lambda automata: np.full(1 << 10, (1 << 64) - 1, dtype=np.uint64))
    rows = texts(7, docs=60)
    assert found(spark, rows, least=4) == plain(rows, 4, 2000)


def test_empty_and_wordless_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en"), (" ., \n", "en")]) == []


def test_score_passes_64_bits(spark):
    from pyspark.sql import functions as F

    big = 9 * 10**15
    row = spark.range(1).select(phrases._score(F.lit(big), F.lit(big), F.lit(big + 7)).alias("s")).first()
    assert row.s == 2_000_000 * big // (2 * big + 7)


def test_automata_keep_their_paths_and_weights():
    rng = np.random.default_rng(5)
    for k in (1, 2, 4):
        keys = np.unique(rng.integers(0, 6, (200, k)).astype(np.uint64), axis=0)
        weights = rng.integers(1, 99, len(keys))
        automaton = phrases.Automaton(phrases.build(keys, weights))
        got, w = automaton.paths()
        assert (got == keys).all() and (w == weights).all()
        asked = rng.integers(0, 7, (500, k)).astype(np.uint64)
        table = dict(zip(map(tuple, keys.tolist()), weights.tolist(), strict=True))
        assert automaton.weigh(asked).tolist() == [table.get(tuple(q), 0) for q in asked.tolist()]
        both, sums = phrases.unite([(keys, weights), (keys[::2], weights[::2])])
        assert (both == keys).all() and sums.tolist() == [2 * x if i % 2 == 0 else x for i, x in enumerate(weights.tolist())]
