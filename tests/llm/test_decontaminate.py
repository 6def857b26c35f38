import hashlib
import re

from pyspark.sql import functions as F

from tideline.llm import decontaminate as dc


def plain(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(str(item) if item is not None else None, w[i : i + n]) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {item} - {None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, LONG), (10, "Short ITEM é"), (2, None), (3, "--"), (None, "nameless words here"), (1, LONG)]
ROWS = [
    (1, f"before {LONG.upper().replace(' ', ', ')} after"), (1, f"before {LONG} after"), (2, None), (3, ""), (4, "short-item é"), (5, "a short item é, b"),
    (6, "nameless words here"), (None, LONG[5:]), (7, "x " * 200_000 + LONG), (8, "short item é " * 3),
]


def test_equals_brute_force_carried_and_joined(spark, documents):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for size in (dc.BLOCK_BYTES, 20):
        found = dc.scan_benchmark(documents(ROWS), benchmark, block_bytes=size)
        got = [(r.doc_id, r.leak.n_words, r.leak.n_hit, r.leak.n_items, r.leak.items_sha256, r.leak.contaminated) for r in found.collect()]
        assert sorted(got, key=str) == sorted(plain(ROWS, ITEMS), key=str)


def test_joined_equals_carried_with_copies_hot_windows_and_a_full_filter(spark, documents, monkeypatch):
    """The table form on many copies of one text, a window in most texts, clashing columns and a filter that lets everything through."""
    benchmark = spark.createDataFrame([*ITEMS, (3, "the"), (4, "the"), (5, None)], "item_id bigint, text string")
    rows = [(i, f"the copy of {LONG}") for i in range(40)] + [(i, f"text {i} has the word") for i in range(40, 90)] + [(i, f"clean number {i}") for i in range(90, 120)] + ROWS
    docs = documents(rows).withColumns({"weight": F.lit(1), "digest": F.lit("d"), "__digest": F.lit("e"), "spans": F.lit(2)})
    key = lambda df: sorted((str(r.doc_id), str(r.leak.asDict(True)), r.weight, r["__digest"]) for r in df.collect())
    want = key(dc.scan_benchmark(docs, benchmark, with_text=True))
    assert len(want) == len(rows)
    assert key(dc.scan_benchmark(docs, benchmark, with_text=True, block_bytes=1)) == want
    monkeypatch.setattr(dc, "_bit_filter", lambda windows: b"\xff" * 64)
    assert key(dc.scan_benchmark(docs, benchmark, with_text=True, block_bytes=1)) == want


def test_the_filter_has_the_bits_of_all_windows_and_few_others(spark):
    rows = spark.range(20_000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"))
    bits = dc._bit_filter(rows)
    mask = len(bits) * 8 - 1
    hashes = [r.h & mask for r in rows.collect()]
    assert len(bits) == 1 << 16 and all(bits[h >> 3] >> (h & 7) & 1 for h in hashes)
    assert sum(b.bit_count() for b in bits) == len(set(hashes))


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.leak.contaminated for r in dc.scan_benchmark(documents([(1, "a b")]), none).collect()] == [False]
    assert dc.scan_benchmark(documents([]), none).collect() == []


def test_passages_are_cut_and_mostly_hit_documents_go(spark, documents):
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    text = "Clean words. " * 9 + f"See: {LONG}! Done."
    out = dc.decontaminate(documents([(1, text), (2, LONG + " end"), (3, "clean"), (4, None)]), benchmark)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, "Clean words. " * 9 + "See: ! Done."), (3, "clean"), (4, None)}
    assert out.columns == documents([]).columns
