import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import ordered as O
from tideline.operators import sampling as S
from tideline.operators.hashrank import hash_bands

RNG = np.random.default_rng(3)
N = 2000
DATA = pd.DataFrame(
    {
        "id": np.arange(N),
        "k": np.where(RNG.uniform(size=N) < 0.4, "hot", RNG.choice(list("abcdef"), N)),
        "t": RNG.integers(0, 50, N),
        "v": RNG.choice(["low", "medium", "high"], N),
        "y": RNG.integers(0, 2, N),
    }
)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(DATA).withColumn("ts", F.timestamp_seconds(F.col("t") * 7200))


def test_top_n_per_key(df):
    got = O.top_n_per_key(df, ["k"], [F.col("t").desc(), F.col("id").desc()], 25, salts=5).toPandas()
    want = DATA.sort_values(["t", "id"], ascending=False).groupby("k").head(25)
    assert sorted(got["id"]) == sorted(want["id"])


@pytest.mark.parametrize("rows", [3, 150, None])
def test_previous_value_equals_lag(df, rows):
    got = O.previous_value(df, ["k"], "ts", "id", "v", "prev", rows).toPandas().set_index("id")["prev"]
    want = DATA.sort_values(["t", "id"]).assign(p=lambda d: d.groupby("k")["v"].shift()).set_index("id")["p"]
    for i in range(N):
        a, b = got[i], want[i]
        assert (a is None or a != a) and (b is None or b != b) or a == b


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, keys, descending):
    base = DATA.groupby([*keys, "t"], as_index=False)["y"].sum()
    got = O.running_totals(spark.createDataFrame(base), "t", ["y"], keys, descending, buckets=7).toPandas()
    got = got.sort_values([*keys, "t"]).reset_index(drop=True)
    base = base.sort_values([*keys, "t"], ascending=[True] * len(keys) + [not descending])
    base["cum_y"] = base.groupby(keys)["y"].cumsum() if keys else base["y"].cumsum()
    base = base.sort_values([*keys, "t"]).reset_index(drop=True)
    assert got["cum_y"].tolist() == base["cum_y"].tolist()
    assert len(got) == len(base)


def test_null_keys_have_totals_of_their_own(spark):
    rows = spark.createDataFrame([(None, float(i), i) for i in range(40)] + [("a", float(i), 1) for i in range(40)], "k string, x double, m int")
    got = O.running_totals(rows, "x", ["m"], ["k"], False, buckets=6).collect()
    assert len(got) == 80
    assert all(r["cum_m"] == (sum(range(int(r["x"]) + 1)) if r["k"] is None else r["x"] + 1) for r in got)


def test_a_hot_key_in_a_narrow_range_is_cut_like_the_rest(spark):
    """A third of all rows are of one key: within one minute (order by time), or within a ten thousandth of the values."""
    n = 30_000
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 2000).alias("ts"), (0.5 + F.col("id") / (n * 10_000.0)).alias("x"), "id")
    rest = spark.range(n, 3 * n).select((F.col("id") % 50).cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.rand(1).alias("x"), "id")
    for order in (["k", "ts", "id"], ["k", "x"]):
        sizes = [r["count"] for r in O.in_ranges(hot.unionByName(rest), order, "b", 3000).groupBy("b").count().collect()]
        assert len(sizes) == 30 and max(sizes) < 2 * np.median(sizes)


def test_the_first_rows_of_a_key_leave_session_options_alone(spark):
    rows = spark.range(5000).withColumn("k", F.col("id") % 2)
    before = spark.conf.get(O.WINDOW_LIMIT, None)
    assert O.top_n_per_key(rows, ["k"], [F.col("id")], 2000).agg(F.max("id")).first()[0] == 3999
    assert spark.conf.get(O.WINDOW_LIMIT, None) == before


def test_bands_hold_exact_counts_and_do_not_depend_on_partitioning(df):
    cuts = [F.floor(F.col("n") * 0.3), F.floor(F.col("n") * 0.8), F.col("n") + 5]
    one = hash_bands(df.repartition(1), ["id"], 9, cuts, ["k"]).toPandas()
    many = hash_bands(df.repartition(16, "t"), ["id"], 9, cuts, ["k"]).toPandas()
    assert dict(zip(one["id"], one["band"])) == dict(zip(many["id"], many["band"]))
    for _, part in one.groupby("k"):
        n = len(part)
        assert [sum(part["band"] == b) for b in range(3)] == [int(n * 0.3), int(n * 0.8) - int(n * 0.3), n - int(n * 0.8)]


def test_bands_refuse_ids_that_do_not_identify_rows(df):
    with pytest.raises(ValueError):
        S.exact_sample(df, 100, ["k"]).count()


def test_stratified_split_sizes(df):
    got = S.stratified_split(df, "k", ["id"]).groupBy("k", "split").count().toPandas()
    for k, part in got.groupby("k"):
        n = int(part["count"].sum())
        sizes = dict(zip(part["split"], part["count"]))
        held = int(np.ceil(n * 0.4))
        assert sizes["train"] == n - held and sizes["test"] == int(np.ceil(held * 0.5))
    assert S.stratified_split(df, "k", ["id"]).count() == N
    with pytest.raises(ValueError):
        S.stratified_split(df, "k", ["id"], 0.5, 0.5)


def test_samples(df):
    assert S.exact_sample(df, 123, ["id"]).select("id").distinct().count() == 123
    assert S.exact_sample(df, 10 * N, ["id"]).count() == N
    assert S.sample(df, 3 * N, ["id"]).count() == 3 * N
    positives = S.class_conditional_sample(df, 100, F.col("y") == 1, ["id"])
    assert positives.count() == 100 and positives.where("y = 0").isEmpty()
    rare = df.where("y = 0 or id < 20")
    assert not S.class_conditional_sample(rare, 400, F.col("y") == 1, ["id"]).where("y = 0").isEmpty()


def test_set_fraction(df):
    changed = S.set_fraction(df, "v", "high", 0.25, ["id"], source=df)
    before = DATA.set_index("id")["v"]
    rows = changed.select("id", "v").toPandas().set_index("id")["v"]
    assert (rows != before).sum() <= 500 and (rows == "high").sum() >= 500
    assert S.set_fraction(df, "v", "never", 0.25, ["id"], source=df).where("v = 'never'").isEmpty()
    one = S.set_fraction(df.withColumn("v", F.lit("low")), "v", "high", 1e-9, ["id"], source=df)
    assert one.where("v = 'high'").count() == 1
