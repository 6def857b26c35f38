import random
from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tideline.llm import alignment
from tideline.llm.queries import QUERIES

KINDS = "doc_id bigint, text string, row string, radix int"


SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
HIDDEN = [b for b in range(256) if b not in SHOWN]


def byte_of(char):
    """The byte that a character of a byte-level entry stands for."""
    return ord(char) if ord(char) < 256 else HIDDEN[ord(char) - 256]


def plain(rows):
    """Every token and link by itself."""
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, counts = [], Counter()
    for id_, text in rows:
        left = right = []
        if text:
            want = b" " + text.encode()
            left = [(i, bytes(map(byte_of, a.id_to_token(i)))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            right = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
            if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
                left = right = []
        ends = []
        for side in (left, right):
            at, found = 0, []
            for i, x in side:
                at += len(x)
                found.append((at, i))
            ends.append(found)
        last = dict(ends[0])  # no token is empty, so one token at most ends at a byte
        links = [(last[e], j) for e, j in ends[1] if e in last]
        cuts = sorted(last.keys() & {e for e, _ in ends[1]})
        groups = [([], []) for _ in cuts]
        for k, side in enumerate(ends):
            for e, i in side:
                groups[bisect_left(cuts, e)][k].append(str(i))
        halves = [",".join(x) + "|" + ",".join(y) for x, y in groups]
        counts.update(links)
        docs.append((id_, len(left), len(right), len(cuts), links, sha256(";".join(halves).encode()).hexdigest() if left else ""))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return sorted(((i, n, m, g, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), h) for i, n, m, g, ls, h in docs), key=repr)


def found(spark, rows):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], KINDS)
    return sorted((tuple(r) for r in alignment.align(table).collect()), key=repr)


ODD = ["", None, " ", "  two  blanks ", "tab\there", "line\nline\r\n\n", "<|endoftext|> </s><s> <unk> <0x41>", "has ▁ in it", "▁", "Ünïcödé 日本語 текст", "🙂🙃 ‍﻿", "á é", "\x00\x01\x1f",
       "x" * 300, "don't they'll 12345 3.14", " nbsp　wide", "ﬁ ligature ½ ²", "=" * 70 + " " * 70]


@pytest.mark.parametrize("run", [1 << 18, 7])
def test_equals_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(alignment, "RUN", run)
    monkeypatch.setattr(alignment, "MERGED", 2 if run < 100 else 64)
    rng = random.Random(4)
    words = ["the", "café", "token", "izer", "Zürich", "new", "\n", "über-", "x_1", "naïve", "don't", "42", "don’t"]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    rows += [(None, "no id here"), (None, None), rows[30], rows[30]]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 23), (3, 10)])
def test_words_are_kept_within_limits(spark, monkeypatch, limits):
    rng = random.Random(5)
    words = ["and", "wörter", "12", "a", "...", "x!", "日本", "  ", "\n", "it's", "_", "über"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(900))) for i in range(4)] + [(9, "y" * 5000), (10, "é " * 400)]
    monkeypatch.setattr(alignment, "WORDS", limits[0])
    monkeypatch.setattr(alignment, "CHARS", limits[1])
    monkeypatch.setattr(alignment, "PIECE", 2000)
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pairs_are_bounded_by_the_vocabularies():
    both = alignment.Tokenizers(alignment.vocabulary_files())
    assert max(len(both.first_bytes), 1 << 15) <= 1 << alignment.SIDE and both.pairs() < 1_000_000
    assert not any("▁" in p.lstrip("▁") for p in map(both.second.id_to_piece, range(both.second.get_piece_size())))


def test_query_equals_brute_force_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(spark, rows) == plain(rows)
    assert QUERIES["op11_alignment"](spark, sf).count() == len(rows)
