"""Training-data pipeline over ``documents``: each stage's result is written and read again by the next.

Language identification drops what has no language, line dedup cuts cross-site boilerplate, SimHash keeps one
document of each group of near copies, decontamination cuts benchmark passages, and mixing puts
what is left in the order of the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, language, lines, mixing, simhash
from tideline.llm.common import read, settle
from tideline.llm.queries import ORACLES as OP_ORACLES
from tideline.llm.queries import QUERIES as OP_QUERIES


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and ambiguous ones below the least score, go."""
    return language.stage(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources are cut from all documents but the first that has them."""
    return lines.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.stage(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that mostly consist of them go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixing order, with their slot and the place in it."""
    return mixing.stage(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
]

#: Classifiers, SimHash and the schedule have no SQL form; tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {**OP_QUERIES, "pipeline": run}
ORACLES = {**OP_ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
