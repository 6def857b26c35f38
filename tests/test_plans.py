"""Shape of physical plans: pushed filters, pruned columns, single scans, no nested loops over data."""

import re

import pytest
from pyspark.sql import functions as F

from tideline.operators import decisions as E
from tideline.operators import drift as D
from tideline.operators import profile as P
from tideline.operators import sampling as S
from tideline.queries import QUERIES, views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def profile(spark, sf):
    return P.reference_profile(views.reference(spark, sf), views.NUMERIC, views.CATEGORICAL, F.col("label"))


def test_psi_scans_the_window_once_with_pruned_columns(spark, sf, profile):
    text = plan(D.psi(profile.numeric, views.current(spark, sf), views.NUMERIC))
    assert text.count("FileScan parquet") == 1
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in text
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "l_orderkey" not in schema and "l_returnflag" not in schema
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "EvalPython" not in text


def test_report_cells_come_from_one_scan(spark, sf, profile):
    text = plan(D.cell_counts(profile, views.current(spark, sf), views.NUMERIC, views.CATEGORICAL, F.col("label"), ["segment"]))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "NestedLoop" not in text


def test_chi2_calls_python_on_aggregates_only(spark, sf, profile):
    text = plan(D.chi2(profile.categorical, views.current(spark, sf), views.CATEGORICAL))
    assert text.index("ArrowEvalPython") < text.index("HashAggregate")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_hash_limits_need_no_shuffle_of_the_table(spark, sf):
    orders = views.table(spark, sf, "orders")
    for df in (S.exact_sample(orders, 100, ["o_orderkey"]), S.stratified_split(orders, "o_orderpriority", ["o_orderkey"])):
        assert "Exchange hashpartitioning" not in plan(df) and "Sort " not in plan(df)


def test_windows_are_limited_before_the_shuffle(spark, sf):
    for name in ("rolling_window_last_n", "rolling_window_per_key"):
        text = plan(QUERIES[name](spark, sf))
        lower = text[text.rindex("Exchange hashpartitioning"):]  # below the shuffle of the data
        assert "WindowGroupLimit" in lower and "row_number()" in lower
    for name in ("pending_approvals", "recent_investigations"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["matched_investigations", "valid_approvals", "reconciled_versions", "promotion_gates", "dispatch_plan", "severity_changes"])
def test_table_joins_are_equi_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "EvalPython" not in text


def test_new_investigations_avoid_or_joins(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(E, "cut", lambda df: seen.append(plan(df)) or df.checkpoint())
    QUERIES["new_investigations"](spark, sf)
    assert seen and not any("NestedLoop" in p or "CartesianProduct" in p for p in seen)


def test_long_windows_are_limited_before_the_shuffle(spark, sf, monkeypatch):
    """Beyond the thousand rows up to which the window limit is planned by default; the plan is that of the moment the result is made."""
    from tideline.operators import ordered
    from tideline.sources.prediction_log import rolling_window

    seen = []
    monkeypatch.setattr(ordered, "cut", lambda df: seen.append(df._jdf.queryExecution().toString()) or df)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    rolling_window(rows, 2000, "l_shipdate", ["l_orderkey", "l_linenumber"], ["l_returnflag"])
    assert len(seen) == 1 and "WindowGroupLimit" in seen[0] and "Partial" in seen[0]
