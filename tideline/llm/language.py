"""Language identification by error-correcting output codes over binary n-gram classifiers."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 15
#: Labelled documents that the classifiers are fitted on, at most (about), shared out among the languages.
SAMPLE_DOCS = 12_000
FIT_TASKS = 8
#: Share of documents, by crc32 of the id, from which nothing is learned.
FOLDS, HELD_OUT = 4, 2
#: A document whose best language leads the second by less than this is ambiguous.
MARGIN = 0.2
MIN_SCORE = 0.5
SMOOTHING = 0.5
PIECE = 1 << 20
UNKNOWN = "und"
STATE = "struct<lang_pred: string, score: double, second: string, ambiguous: boolean>"

# Small letters and other bytes stay, the rest of ASCII is white space.
NORMAL = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets (and one for no n-gram) x bits
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def has_letter(text: str) -> bool:
    """Is there a letter (Unicode category L)? Signs that only look like numbers or letters are none."""
    return any(map(str.isalpha, text))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: all distinct splits of few languages, the best of many random codes for more."""
    if k <= 5:
        columns = [[1] + [1 if (v >> i) & 1 else -1 for i in range(k - 1)] for v in range((1 << (k - 1)) - 1)]
        return np.array(columns, dtype=np.int8).reshape(-1, k).T
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(k)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), (k, width))
        same = code.astype(int) @ code.T
        worst = (width - same[~np.eye(k, dtype=bool)].max()) / 2
        if not (np.abs(code.sum(axis=0)) == k).any() and (best is None or worst > best[0]):
            best = (worst, code)
    return best[1]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the n-gram at every byte, first byte of every text); nothing crosses texts."""
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(NORMAL) + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    value = np.zeros(len(data), dtype=np.uint32)
    value[:-2] = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    bucket = ((value * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    ends = starts + sizes
    bucket[ends - 1] = bucket[ends - 2] = BUCKETS
    return bucket, starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, 1, PIECE):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))[:] += np.bincount(grams([text])[0], minlength=BUCKETS + 1)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.tobytes() for c in counts.values()])], ["lang", "counts"])


def _margins(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Mean log odds of every bit for each text."""
    bucket, starts = grams(texts)
    sums = np.add.reduceat(weights[bucket], starts, axis=0)
    return sums / np.maximum(1, np.add.reduceat(bucket < BUCKETS, starts))[:, None]


def _train_margins(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                m = _margins(weights, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(np.float64).tobytes() for x in m])], ["lang", "margins"])

    return run


def _calibrate(margin: np.ndarray, sign: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of the sign on the margin, by damped Newton steps."""
    scale = float(np.std(margin)) or 1.0
    x, y, theta = np.stack([margin / scale, np.ones_like(margin)], axis=1), (sign > 0).astype(float), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(2)
        theta -= np.linalg.solve(hessian, x.T @ (p - y) + 1.0 * theta)
    return max(0.0, float(theta[0])) / scale, float(theta[1])


def held_out(id_: Column) -> Column:
    """Is nothing learned from this document? A row without an id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Fit on labelled documents that are not held out; None if there is none with a letter.

    Half of a bounded sample, the same number of documents of every language where there are as many,
    gives the n-gram counts; the other half calibrates each bit and weighs its loss. Texts are taken whole.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = {x: min(1.0, sample_docs / len(languages) / n) for x, n in sizes.items()}
    limit = F.element_at(F.create_map(*[F.lit(v) for x in languages for v in (x, int(share[x] * (1 << 24)))]), F.col("lang"))
    draw = F.xxhash64("id", F.lit("fit"))
    sample = rows.where(F.pmod(draw, F.lit(1 << 24)) < limit).withColumn("half", F.pmod(F.shiftright(draw, 24), F.lit(2)))
    counts = {x: np.full(BUCKETS + 1, SMOOTHING) for x in languages}
    for r in sample.where("half = 0").select("lang", "text").repartition(FIT_TASKS).mapInArrow(_count, "lang string, counts binary").collect():
        counts[r["lang"]] += np.frombuffer(r["counts"], dtype=np.int64)
    code = codewords(len(languages))
    share_of = np.stack([counts[x] / counts[x][:BUCKETS].sum() for x in languages])
    bits = code.shape[1]
    weights = np.zeros((BUCKETS + 1, bits), dtype=np.float32)
    for b in range(bits):
        yes, no = share_of[code[:, b] > 0].mean(axis=0), share_of[code[:, b] < 0].mean(axis=0)
        weights[:BUCKETS, b] = (np.log(yes) - np.log(no))[:BUCKETS]
    fitted = sample.where("half = 1").select("lang", "text").repartition(FIT_TASKS).mapInArrow(_train_margins(weights), "lang string, margins binary").collect()
    slope, offset, trust = np.ones(bits), np.zeros(bits), np.ones(bits)
    if fitted and bits:
        margins = np.stack([np.frombuffer(r["margins"]) for r in fitted])
        truth = code[[languages.index(r["lang"]) for r in fitted]]
        for b in range(bits):
            slope[b], offset[b] = _calibrate(margins[:, b], truth[:, b])
            wrong = (np.sum((slope[b] * margins[:, b] + offset[b]) * truth[:, b] <= 0) + 1) / (len(fitted) + 2)
            trust[b] = max(0.05, 0.5 * np.log((1 - wrong) / wrong))
        trust /= trust.sum()
    return Model(languages, code, weights, slope, offset, trust)


def decode(model: Model, texts: list[str]) -> list[tuple[str, float, str | None, bool]]:
    """(best language, its score, second, ambiguous?) by the least weighted loss over the bits."""
    if not texts:
        return []
    k = len(model.languages)
    z = _margins(model.weights, texts) * model.slope + model.offset
    loss = np.stack([(np.logaddexp(0, -model.code[c] * z) * model.trust).sum(axis=1) for c in range(k)], axis=1)
    # Half of the bits tell a pair of languages apart, so the mean loss is put on the scale of one decision.
    odds = np.exp(-2 * (loss - loss.min(axis=1, keepdims=True)))
    score = odds / odds.sum(axis=1, keepdims=True)
    order = np.argsort(-score, axis=1, kind="stable")
    out = []
    for row, o in zip(score, order, strict=True):
        second = o[1] if k > 1 else None
        lead = row[o[0]] - (row[second] if second is not None else 0)
        out.append((model.languages[o[0]], float(row[o[0]]), model.languages[second] if second is not None else None, bool(lead < MARGIN)))
    return out


def _predict(model: Model | None, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_at, PIECE):
                texts = part.column(text_at).to_pylist()
                known = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
                out = [{"lang_pred": UNKNOWN, "score": 0.0, "second": None, "ambiguous": True}] * len(texts)
                for i, (best, score, second, unsure) in zip(known, decode(model, [texts[i] for i in known]) if known else [], strict=True):
                    out[i] = {"lang_pred": best, "score": score, "second": second, "ambiguous": unsure}
                state = pa.array(out, type=batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], state], schema=batch.schema)

    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "language") -> DataFrame:
    """Add a struct column: lang_pred, score (0 to 1), second best language, ambiguous.

    Only the whole text counts. A text that is null or has no letter, and any text without a model, is
    ``und`` with score 0 and ambiguous. Ties go to the language that sorts first.
    """
    work = docs.withColumn(out, F.lit(None).cast(STATE))
    return work.mapInArrow(_predict(model, work.columns.index(text_col)), work.schema)


def stage(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents with a language: those without letters go, and ambiguous ones below the least score."""
    name = fresh(docs, "__language")
    found = predict(docs, fit(docs), out=name)
    kept = found.where((F.col(f"{name}.lang_pred") != UNKNOWN) & ~(F.col(f"{name}.ambiguous") & (F.col(f"{name}.score") < min_score)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
