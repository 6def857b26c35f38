import random

from tideline.llm import chat

KIND = "conv_id bigint, turn int, role string, text string, pos string"


def plain(rows):
    turns = {}
    for c, t, r, x, _ in rows:
        turns.setdefault(c, set()).add((t is not None, t or 0, r or "unknown", x or ""))
    digest = lambda r, x: __import__("hashlib").md5(f"{r}\x00{x}".encode()).hexdigest()
    of = {c: tuple((r, x) for _, _, r, x in sorted(s, key=lambda v: (v[0], v[1], digest(v[2], v[3])))) for c, s in turns.items()}
    out = []
    for content in set(of.values()):
        same = [c for c in of if of[c] == content]
        if any(len(o) > len(content) and o[: len(content)] == content for o in of.values()):
            continue
        known = [c for c in same if c is not None]
        for k in range(0, len(content), chat.CHUNK):
            text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in content[k : k + chat.CHUNK])
            out.append((min(known) if known else None, len(content), len(same), k // chat.CHUNK, text))
    return sorted(out, key=str)


def run(spark, rows):
    return sorted([tuple(r) for r in chat.collapse(spark.createDataFrame(rows, KIND)).collect()], key=str)


def test_equals_brute_force(spark):
    rng, rows = random.Random(2), []
    for c in range(60):
        base = random.Random(c % 7)
        length = rng.choice([1, 2, 3, 5, 130])
        rows += [(c, t, ("user", "assistant")[t % 2], f"{base.random()} {t}" if t else "hello", "x") for t in range(length)]
    rows += rows[:20] + [(100, None, None, None, None), (100, 3, None, "", None), (101, 5, "user", "hello", "x"), (102, 1, "user", "b", "x"), (102, 1, "user", "a", "x")]
    rows += [(None, 0, "user", "hello", "x"), (None, 1, "tool", "only here", "x"), (103, 0, "user", "w " * 100_000, "x")]
    rng.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_empty_and_all_equal(spark):
    assert run(spark, []) == []
    rows = [(c, t, "user", f"t{t}", None) for c in range(30) for t in range(3)]
    assert run(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_order_matters(spark):
    rows = [(1, 0, "user", "a", None), (1, 1, "user", "b", None), (2, 0, "user", "b", None), (2, 1, "user", "a", None), (2, 2, "user", "c", None)]
    assert run(spark, rows) == plain(rows) and len(plain(rows)) == 2
