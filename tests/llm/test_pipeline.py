import hashlib  # noqa: F401
import random
from collections import Counter

import pytest
from test_decontaminate import plain as plain_leaks
from test_lines import plain as plain_lines
from test_mixing import plain as plain_slots
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from tideline.llm import decontaminate, language, mixing

SF = "/root/testdata/sf0.001"


def by_hand(spark, docs, benchmark):
    """The pipeline in plain Python; only the fitted model is shared."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    model = language.fit(docs)
    kept = []
    for r in rows:
        if r[1] and language.has_letter(r[1]):
            best = language.decode(model, [r[1]])[0]
            if not (best[3] and best[1] < language.MIN_SCORE):
                kept.append(r)
    texts = dict(plain_lines(kept, 5))
    kept = [(i, texts[i], lang, s) for i, _, lang, s in kept]
    roots = plain_components({i: plain_fingerprint(t) for i, t, _, _ in kept})
    kept = [r for r in kept if roots[r[0]] == r[0]]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    leaks = {i: (n, hit) for i, n, hit, *_ in plain_leaks([r[:2] for r in kept], items)}
    return [r for r in kept if leaks[r[0]][1] <= decontaminate.DROP_SHARE * leaks[r[0]][0]], {i for i, x in leaks.items() if x[1]}, items


def test_run_equals_the_stages_by_hand(spark):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want, cut, items = by_hand(spark, docs, benchmark)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r[0] for r in want}
    assert all(got[i].text == t and got[i].lang == lang for i, t, lang, _ in want if i not in cut)
    assert not any(hit for _, _, hit, *_ in plain_leaks([(i, got[i].text) for i in cut if i in got], items))
    sizes = Counter(r[3] for r in want)
    blocks = {s: -(-n // mixing.BLOCK) for s, n in sizes.items()}
    slots = plain_slots(mixing.slot_counts({s: n**mixing.TEMPERATURE for s, n in sizes.items()}), blocks)
    assert sorted({(r.source, r.mix_slot) for r in got.values()}) == sorted((s, slot) for (s, _), slot in slots.items())


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(30)), ("en", None)[i % 2], ("hot", f"s{i}")[i % 3 == 0], "x", i) for i in range(60)]
    rows += [(70, None, None, None, None, None), (71, "", "en", None, "x", 1), (None, "lone words here", None, None, None, None), rows[0], rows[0], (72, "99", "en", "hot", "x", 1)]
    rows += [(73, rows[1][1], "en", "s1", None, None), (74, "long " * 50_000, None, "hot", "x", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, component string, mix_slot int")


def test_stages_take_odd_rows_and_clashing_columns(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert out.columns[: len(before.columns)] == before.columns
        assert out.columns == before.columns or name == "mixing"
    ids = Counter(r.doc_id for r in docs.collect())
    assert ids == Counter([*range(60), None, 74])


def test_stages_take_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).collect() == []


def test_stages_keep_order_and_number():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
