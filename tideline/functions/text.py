"""Cleaning and flagging of free text taken from outside."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ship these functions with the task; executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Length limits, pattern list, wrapping tags.
MAX_EXTERNAL = 4096
MAX_FEATURE = 512
SUSPICIOUS = (
    r"ignore previous",
    r"you are now",
    r"system prompt",
    r"\n\nHuman:",
    r"\n\nAssistant:",
    r"<\|system\|>",
)
OPEN_TAG = "<external_data>\n"
CLOSE_TAG = "\n</external_data>"

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACES = "\t\n\r " + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form. Plain ASCII is its own form, so only other texts travel to Python."""
    other = text.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_nfkc(F.when(other, text)), text)


def clean(text: Column, normalize: bool = True) -> Column:
    """The whole text in NFKC, without control characters, with single blanks, trimmed."""
    if normalize:
        text = nfkc(text)
    text = F.regexp_replace(text, CONTROL, "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(text, F.lit(SPACES))


def sanitize(text: Column, max_len: int = MAX_EXTERNAL, normalize: bool = True) -> Column:
    """The cleaned text, cut to ``max_len`` characters."""
    return F.substring(clean(text, normalize), 1, max_len)


def suspicious(text: Column, patterns: tuple[str, ...] = SUSPICIOUS) -> Column:
    """Array of the patterns found, ignoring case."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(p)) for p in patterns]))


def delimit(text: Column) -> Column:
    return F.concat(F.lit(OPEN_TAG), text, F.lit(CLOSE_TAG))


def sanitize_text(df: DataFrame, column: str, max_len: int = MAX_EXTERNAL, normalize: bool = True) -> DataFrame:
    return df.withColumn(column, sanitize(F.col(column), max_len, normalize))


def flag_patterns(df: DataFrame, column: str, out: str = "patterns") -> DataFrame:
    """Patterns are looked for in the whole cleaned text, so wide letters, doubled blanks or length do not hide them."""
    return df.withColumn(out, suspicious(clean(F.col(column))))
