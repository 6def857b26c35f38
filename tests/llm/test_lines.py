from collections import defaultdict

from pyspark.sql import functions as F

from tideline.llm import lines


def plain(rows, least, keep_first=True):
    key = lambda x: " ".join(x.split(" ")).strip() if x else ""
    sites, first = defaultdict(set), {}
    order = sorted(set((r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None))
    for i, text, _, site in rows:
        for n, x in enumerate((text or "").split("\n")):
            if key(x):
                sites[key(x)].add(site)
    out = []
    for no_id, i, text in order:
        for n, x in enumerate(text.split("\n")):
            first.setdefault(key(x), (no_id, i, text, n))
    for i, text, _, site in rows:
        if text is None:
            out.append((i, None))
            continue
        gone = lambda n, x: len(sites.get(key(x), ())) >= least and not (keep_first and first[key(x)] == (i is None, i or 0, text, n))
        out.append((i, "\n".join(x for n, x in enumerate(text.split("\n")) if not gone(n, x))))
    return sorted(out, key=str)


ROWS = [(i, f"own {i}\nshared by all\n\n  few {i % 9} \nend", None, f"site{i % 8}") for i in range(40)]
ROWS += [(50, None, None, "a"), (51, "", None, None), (52, "shared by all\nshared by all", None, None), (53, "own 3", None, None), (53, "own 3", None, None)]
ROWS += [(54, "x\n" * 50_000 + "shared by all", None, "z")]


def run(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_equals_brute_force(spark, documents):
    docs = documents(ROWS)
    for keep in (True, False):
        out = lines.dedup_lines(docs, min_sites=5, keep_first=keep)
        assert out.columns == docs.columns and run(out) == plain(ROWS, 5, keep)
    assert lines.dedup_lines(documents([])).collect() == []


def test_rows_without_id(spark, documents):
    rows = [(None, "shared\nmine", None, f"s{i}") for i in range(3)] + [(i, "shared\nother", None, f"s{i}") for i in range(6)]
    got = run(lines.dedup_lines(documents(rows), min_sites=5))
    assert got.count((None, "mine")) == 3 and (0, "shared\nother") in got and got.count((1, "")) == 1


def test_threshold_is_exact_at_any_spread(spark):
    """Sites from just below to just above the threshold, where sketches alone would err."""
    rows = spark.range(60).select(F.format_string("line%d", "id").alias("key"), F.explode(F.sequence(F.lit(1), F.col("id") + 470)).alias("site"))
    got = {r.key for r in lines.boilerplate(rows.select("key", F.col("site").cast("string").alias("site")), 500).collect()}
    assert got == {f"line{k}" for k in range(30, 60)}
