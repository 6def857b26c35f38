import random

import numpy as np
import pytest

from tideline.llm import licenses as lic
from tideline.llm.queries import QUERIES


def full(template, words):
    """Best local alignment over all cells: score only."""
    s = np.zeros((len(template) + 1, len(words) + 1), dtype=int)
    for i in range(len(template)):
        for j in range(len(words)):
            s[i + 1, j + 1] = max(0, s[i, j] + (1 if template[i] == words[j] else -1), s[i, j + 1] - 1, s[i + 1, j] - 1)
    return s.max()


def words(text):
    return text.encode().translate(lic.NORMAL).split()


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        w[at : at + 1] = [["zz"], [w[at], "yy"], []][kind]
    return " ".join(w)


def test_common_runs_share_a_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        run = [rng.randrange(1, 6) for _ in range(lic.GRAM + lic.WINNOW - 1)]
        a, b = ([rng.randrange(1, 6) for _ in range(9)] + run + [rng.randrange(1, 6) for _ in range(9)] for _ in range(2))
        assert set(lic.winnow(np.array(a))[1].tolist()) & set(lic.winnow(np.array(b))[1].tolist())


def test_band_alignment_equals_full_alignment():
    rng = random.Random(2)
    for name, text in lic.TEMPLATES.items():
        for edits in (0, 1, 3):
            doc = "x y z " + edited(rng, text, min(edits, len(text.split()) // 8)) + " p q r"
            vocab = {w: k + 1 for k, w in enumerate(dict.fromkeys(words(text)))}
            t, d = ([vocab.get(w, 0) for w in words(x)] for x in (text, doc))
            matched, first, stop = lic.align(np.array(t), np.array(d), 3, 2 * lic.band_of(len(t)))
            assert first >= 3 and stop <= len(d) - 3
            assert matched >= full(t, d) and matched <= len(t) and full(t, d[first:stop]) == full(t, d)


def test_findings_spans_and_coverage(spark, documents):
    rng = random.Random(3)
    rows, want = [], {}
    for i, (name, text) in enumerate(lic.TEMPLATES.items()):
        rows.append((i, f"Été: {text.upper()} fin"))
        want[i] = {name}
        rows.append((100 + i, "intro " + edited(rng, text, len(text.split()) // 12) + " outro"))
        want[100 + i] = {name}
    want[lic_index("apache-2.0")] |= {"apache-2.0-line"}
    got = {r.doc_id: r.licenses for r in lic.scan_licenses(documents(rows), best=False).collect()}
    for i, found in want.items():
        assert found <= {m.license for m in got[i]}
    best = {r.doc_id: r.licenses for r in lic.scan_licenses(documents(rows)).collect()}
    for i, name in enumerate(lic.TEMPLATES):  # variants are told apart, whole and edited
        assert [m.license for m in best[i]] == [name] and [m.license for m in best[100 + i]] == [name]
    for i, (name, text) in enumerate(lic.TEMPLATES.items()):
        hit = next(m for m in got[i] if m.license == name)
        assert hit.coverage == 1.0 and words(rows[2 * i][1][hit.start : hit.stop]) == words(text)


def test_best_of_overlapping_findings():
    finding = lambda name, coverage, start, stop: {"license": name, "coverage": coverage, "start": start, "stop": stop}
    sizes = {"a": 10, "b": 10, "long": 40, "line": 4}
    names = lambda *found: [x["license"] for x in lic.best_of(list(found), sizes)]
    assert names(finding("line", 1.0, 0, 20), finding("long", 0.9, 0, 200)) == ["long"]
    assert names(finding("a", 0.9, 0, 50), finding("b", 1.0, 3, 50)) == ["b"]
    assert names(finding("a", 1.0, 0, 50), finding("b", 1.0, 0, 50)) == ["a"]  # ties by name
    assert names(finding("a", 1.0, 0, 50), finding("b", 1.0, 45, 90)) == ["a", "b"]  # they touch only
    assert names(finding("a", 1.0, 0, 50), finding("a", 1.0, 60, 110)) == ["a", "a"] and names() == []


def test_templates_from_a_table(spark, documents):
    named = spark.createDataFrame([("own", "this text may be used by anyone who asks for it"), ("own", "this text may be used by anyone who asks for it"), (None, "x"), ("none", None)], "license string, text string")
    docs = documents([(1, "Note: this text may be used by anyone who asks for it."), (2, "this text"), (3, None)])
    got = {r.doc_id: [m.license for m in r.licenses] for r in lic.scan_licenses(docs, named).collect()}
    assert got == {1: ["own"], 2: [], 3: []}
    assert all(r.licenses == [] for r in lic.scan_licenses(docs, named.limit(0)).collect())
    with pytest.raises(ValueError, match="bytes"):
        lic.template_table(named, limit=10)
    with pytest.raises(ValueError, match="several texts"):
        lic.template_table(named.unionByName(spark.createDataFrame([("own", "other")], named.schema)))


def lic_index(name):
    return list(lic.TEMPLATES).index(name)


def test_nulls_repeats_long_texts_blocks(spark, documents):
    line = lic.TEMPLATES["mit-line"]
    rows = [(1, None), (2, ""), (3, f"{line} {line}\n{line}"), (3, f"{line} {line}\n{line}"), (None, line), (4, "the license " * 50_000 + line), (5, "Released under")]
    for size in (lic.BLOCK_BYTES, 10):
        got = sorted(((r.doc_id, len(r.licenses)) for r in lic.scan_licenses(documents(rows), block_bytes=size).collect()), key=str)
        assert got == sorted([(1, 0), (2, 0), (3, 3), (3, 3), (None, 1), (4, 1), (5, 0)], key=str)
    assert lic.scan_licenses(documents([])).collect() == []


def test_query_equals_a_plain_search_for_the_lines(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.matches for r in QUERIES["op2_licenses"](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        flat = b" ".join([b"", *words(text), b""])
        for name in ("mit-line", "gpl-3.0-line", "apache-2.0-line", "cc-by-nc-4.0-line"):
            if b" ".join([b"", *words(lic.TEMPLATES[name]), b""]) in flat:
                assert f"{name}:1.0000:" in got[i]


def best_alignment(template, words):
    """(score, most matched words of an alignment with that score) over all cells, without bands: row by row of the template."""
    # Cells are score * 1000 + matched words; both are maximised, the score first.
    before, best = np.zeros(len(words) + 1, dtype=np.int64), 0
    gap, steps = 1000, np.arange(len(words) + 1, dtype=np.int64) * 1000
    for word in template:
        row = np.maximum(before - gap, 0)
        row[1:] = np.maximum(row[1:], before[:-1] + np.where(words == word, 1001, -1000))
        row = np.maximum(row, 0)
        before = np.maximum(np.maximum.accumulate(row + steps) - steps, 0)
        best = max(best, int(before.max()))
    return divmod(best, 1000)


def runs(ids, n):
    return {tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_whole_query_equals_unbanded_alignment_of_every_template(spark, sf):
    """Every text against every template in full, without fingerprints, diagonals or bands.

    What is reported reaches the coverage there too. What reaches it there, and has a run of words with the template in
    common that is long enough for a sure fingerprint, is reported, with at least 0.7 of its words.
    """
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rng = random.Random(8)
    names = list(lic.TEMPLATES)
    for k in range(60):  # notices, whole or edited, amid the texts of the table
        words_of = list(texts.values())[k].split()
        at = rng.randrange(len(words_of) + 1)
        notice = edited(rng, lic.TEMPLATES[names[k % len(names)]], rng.randrange(1 + len(lic.TEMPLATES[names[k % len(names)]].split()) // 5))
        texts[10**6 + k] = " ".join([*words_of[:at], notice, *words_of[at:]])
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: {m.license: m for m in r.licenses} for r in lic.scan_licenses(table, best=False).collect()}
    sizes = {name: len(words(text)) for name, text in lic.TEMPLATES.items()}
    everything = {r.doc_id: r.licenses for r in lic.scan_licenses(table, best=False).collect()}
    for r in lic.scan_licenses(table).collect():  # each finding stays, or a kept one that weighs as much overlaps it
        weigh = lambda m: round(2 * m.coverage * sizes[m.license]) - sizes[m.license]
        shared = lambda a, b: min(a.stop, b.stop) - max(a.start, b.start)
        assert set(r.licenses) <= set(everything[r.doc_id])
        assert all(m in r.licenses or any(shared(m, x) > 0 and weigh(x) >= weigh(m) for x in r.licenses) for m in everything[r.doc_id])
    query = {r.doc_id: r for r in QUERIES["op2_licenses"](spark, sf).collect()}
    kept = {r.doc_id: [m.license for m in r.licenses] for r in lic.scan_licenses(table).collect()}
    assert all(query[i].n_matches == len(kept[i]) and [x.split(":")[0] for x in query[i].matches.split(",") if x] == kept[i] for i in query)
    reported = missed = 0
    for i, text in texts.items():
        vocab = {}
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in words(text)], dtype=np.int64)
        four = runs(ids.tolist(), lic.GRAM + lic.WINNOW - 1)
        for name in names:
            template = [vocab.get(w, -1) for w in words(lic.TEMPLATES[name])]
            _, matched = best_alignment(template, ids)
            enough = matched >= lic.MIN_COVERAGE * len(template)
            if name in got[i]:
                hit = got[i][name]
                reported += 1
                part = np.array([vocab[w] for w in words(text[hit.start : hit.stop])], dtype=np.int64)
                assert enough and best_alignment(template, part)[1] >= round(hit.coverage * len(template))
            elif enough:
                missed += 1
                assert not four & runs(template, lic.GRAM + lic.WINNOW - 1), (i, name)
    assert reported > 60 and missed < reported / 10
