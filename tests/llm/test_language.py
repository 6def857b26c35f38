import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import language
from tideline.llm.queries import QUERIES

EN, DE = "the house and the garden with all those things", "das Haus und der Garten mit allen diesen Dingen"


@pytest.fixture(scope="module")
def small(spark, documents):
    rows = [(i, f"{(EN, DE)[i % 2]} {i}", ("en", "de")[i % 2], "s") for i in range(80)]
    return documents(rows)


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 5, 12, 40):
        code = language.codewords(k)
        gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= max(1, 2 ** (k - 2) if k <= 5 else code.shape[1] // 5)


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_language"](spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    rows = [r for r in got if r.held_out]
    right = np.mean([r.lang_pred == truth[r.doc_id][0] for r in rows])
    kept = np.mean([not (r.ambiguous and r.score < language.MIN_SCORE) for r in rows])
    assert right > 0.97 and kept > 0.97, (right, kept)


def test_labels_are_no_input(spark, documents, small):
    model = language.fit(small)
    one = language.predict(documents([(1, EN, "de", "x"), (2, EN, None, None)]), model).collect()
    assert one[0].language == one[1].language and one[0].language.lang_pred == "en"


def test_nulls_letters_repeats_long(spark, documents, small):
    model = language.fit(small)
    rows = [(1, None), (2, ""), (3, "12 -- 3_4"), (None, EN), (5, DE), (5, DE), (6, (EN + "\n") * 30_000), (7, "é"), (8, "日本")]
    got = [(r.doc_id, r.language.lang_pred, r.language.score) for r in language.predict(documents(rows), model).collect()]
    assert [x[1] for x in got[:7]] == ["und", "und", "und", "en", "de", "de", "en"] and got[4] == got[5]
    assert all(x[2] == 0 for x in got[:3]) and all(x[1] in ("en", "de") for x in got[7:])
    assert [r.language.lang_pred for r in language.predict(documents(rows), language.fit(documents(rows))).collect()] == ["und"] * len(rows)
    assert language.predict(documents([]), model).collect() == []


def test_numbers_and_signs_are_no_letters(documents, small):
    rows = [(1, "² ½ ①"), (2, "ªº"), (3, "Ⅷ ⓐ ٣"), (4, "ǅ")]
    got = {r.doc_id: r.language.lang_pred for r in language.predict(documents(rows), language.fit(small)).collect()}
    assert got[1] == got[3] == "und" and got[2] != "und" and got[4] != "und"


def test_stage_keeps_clear_documents(spark, documents, small):
    out = language.stage(small.unionByName(documents([(900, None), (901, "123"), (902, EN)])))
    assert out.columns == small.columns and {r.doc_id for r in out.collect()} == {*range(80), 902}


def test_one_language(spark, documents):
    docs = documents([(i, f"{EN} {i}", "en", "s") for i in range(20)])
    assert {r.language.lang_pred for r in language.predict(docs, language.fit(docs)).collect()} == {"en"}


def plain_grams(text):
    """Buckets of the byte trigrams of a text, one by one."""
    data = b" " + text.lower().encode() + b" "
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in data)
    return [((int.from_bytes(data[i : i + 3], "big") * 0x9E3779B1) % 2**32) >> 17 for i in range(len(data) - 2)]


def test_whole_query_equals_a_plain_model(spark):
    """Counts, weights and decoding by plain Python over every text; only slope, offset and trust are taken as fitted."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    half = F.pmod(F.shiftright(F.xxhash64("doc_id", F.lit("fit")), 24), F.lit(2)).alias("half")
    rows = docs.select("doc_id", "text", "lang", half).collect()
    learned = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text and any(map(str.isalpha, r.text))]
    languages = sorted({r.lang for r in learned})
    assert model.languages == languages and len(learned) < language.SAMPLE_DOCS / len(languages)
    share = {x: [language.SMOOTHING] * language.BUCKETS for x in languages}
    for r in learned:
        if r.half == 0:
            for g in plain_grams(r.text):
                share[r.lang][g] += 1
    for counts in share.values():
        total = sum(counts)
        counts[:] = [c / total for c in counts]
    bits = model.code.shape[1]
    weights = []
    for b in range(bits):
        sides = [[share[x] for x, c in zip(languages, model.code[:, b]) if c * sign > 0] for sign in (1, -1)]
        yes, no = ([sum(v) / len(side) for v in zip(*side)] for side in sides)
        weights.append([math.log(y) - math.log(n) for y, n in zip(yes, no)])
    np.testing.assert_allclose(model.weights[:-1].T, np.array(weights), atol=1e-5)
    got = {r.doc_id: r for r in QUERIES["op10_language"](spark, sf).collect()}
    assert set(got) == {r.doc_id for r in rows} and len(got) == len(rows)
    for r in rows:
        found = got[r.doc_id]
        if not r.text or not any(map(str.isalpha, r.text)):
            assert (found.lang_pred, found.score) == ("und", 0.0)
            continue
        grams = plain_grams(r.text)
        z = [sum(w[g] for g in grams) / len(grams) * model.slope[b] + model.offset[b] for b, w in enumerate(weights)]
        loss = [sum(t * math.log1p(math.exp(-c * v)) for c, v, t in zip(word, z, model.trust)) for word in model.code.tolist()]
        odds = [math.exp(-2 * (x - min(loss))) for x in loss]
        score = [x / sum(odds) for x in odds]
        best = max(range(len(languages)), key=lambda k: (score[k], -k))
        assert found.lang_pred == languages[best] and abs(found.score - score[best]) < 1e-3, r.doc_id
