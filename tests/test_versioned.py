import os

import pytest
from pyspark.sql import functions as F

from tideline.sources import tables as T
from tideline.sources import versioned as V

KIND = "k int, v string, at int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_tables_of_a_version_appear_together_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    assert V.read_version(spark, path).number == -1
    a, b = spark.createDataFrame([(1, "x", 1)], KIND), spark.range(3)
    first = V.publish(spark, path, {"a": a, "b": b}, {"by": "test"})
    assert first.number == 0 and rows(V.read_version(spark, path).table("a")) == rows(a)

    def fails(folder):
        assert os.path.isdir(f"{folder}/a")
        raise ValueError("not good enough")

    with pytest.raises(ValueError):
        V.publish(spark, path, {"a": spark.createDataFrame([(2, "y", 2)], KIND)}, check=fails)
    now = V.read_version(spark, path)
    assert now.number == 0 and rows(now.table("a")) == rows(a) and now.table("b").count() == 3 and now.info["by"] == "test"
    second = V.publish(spark, path, {"a": spark.createDataFrame([], KIND)}, check=lambda folder: {"checked": True})
    assert V.read_version(spark, path).info == {"checked": True} and second.number == 1
    assert rows(V.read_version(spark, path, 0).table("a")) == rows(a)
    with pytest.raises(V.Conflict):
        V.publish(spark, path, {"a": a}, base=0)
    assert rows(V.read_version(spark, path).table("a")) == []
    assert V.expire(spark, path, keep=1) >= 2 and V.read_version(spark, path).number == 1


def test_upsert_equals_latest_wins_and_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path)
    state = spark.range(4000).select(F.col("id").cast("int").alias("k"), F.format_string("value %d", "id").alias("v"), F.lit(5).alias("at"))
    first = V.upsert(spark, path, state, ["k"], ["at", "v"], buckets=64)
    assert rows(V.keyed_table(first)) == rows(state) and len(first.parts) == 64
    whole = size(tmp_path / "data")
    updates = spark.createDataFrame([(7, "new", 9), (7, "older", 8), (8, "late", 1), (9999, None, None)], KIND)
    second = V.upsert(spark, path, updates, ["k"], ["at", "v"])
    assert rows(V.keyed_table(second).na.fill("-").na.fill(-1)) == rows(T.upsert_latest(state, updates, ["k"], ["at", "v"]).na.fill("-").na.fill(-1))
    assert second.info["rewritten"] <= 3 and size(tmp_path / "data") - whole < 0.1 * whole
    assert rows(V.keyed_table(first)) == rows(state)  # a reader of the old version is not disturbed
    assert V.upsert(spark, path, updates.limit(0), ["k"], ["at", "v"]).number == second.number
    V.expire(spark, path, keep=1)
    assert rows(V.keyed_table(V.read_version(spark, path)).na.fill("-").na.fill(-1)) == rows(V.keyed_table(second).na.fill("-").na.fill(-1))


def test_an_overtaken_writer_tries_again(spark, tmp_path, monkeypatch):
    path, commit, once = str(tmp_path), V._commit, []
    V.upsert(spark, path, spark.createDataFrame([(1, "a", 1)], KIND), ["k"], ["at"], buckets=4)

    def overtaken(s, p, number, content):
        if not once:
            once.append(number)
            V.upsert(spark, path, spark.createDataFrame([(1, "other", 3), (2, "b", 1)], KIND), ["k"], ["at"])
        commit(s, p, number, content)

    monkeypatch.setattr(V, "_commit", overtaken)
    done = V.upsert(spark, path, spark.createDataFrame([(1, "mine", 2), (3, "c", 1)], KIND), ["k"], ["at"])
    assert done.number == 2 and rows(V.keyed_table(done)) == [(1, "other", 3), (2, "b", 1), (3, "c", 1)]


def test_empty_table(spark, tmp_path):
    none = V.upsert(spark, str(tmp_path), spark.createDataFrame([], KIND), ["k"], ["at"])
    assert none.number == 0 and rows(V.keyed_table(none)) == []
