"""Plan shape: what must stay true of the physical plans at scale."""

import re

import pytest

from conftest import SF001
from stocklens.plans.analysis import Analysis
from stocklens.sources.fixture import SEGMENT, SNAPSHOT


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_comparison_shuffles_each_input_once(spark, no_broadcast):
    a = Analysis.from_tables(spark, SF001)
    plan = _plan(a.comparison)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # candidate, baseline, factor (by product), baseline+factor, cov, service
    assert len(exchanges) == 6, exchanges
    by_product = [e for e in exchanges if "location" not in e]
    assert len(by_product) == 2  # baseline and factor, for the factor join only
    assert "BroadcastExchange" not in plan


def test_summary_single_partition_only_after_aggregation(spark, no_broadcast):
    a = Analysis.from_tables(spark, SF001)
    plan = _plan(a.summary())
    lines = plan.splitlines()
    single = [i for i, ln in enumerate(lines) if "Exchange SinglePartition" in ln]
    assert len(single) == 1
    # below it (later lines in the tree text) the final and partial aggregates follow
    below = "\n".join(lines[single[0]:])
    assert below.index("HashAggregate") < below.index("Exchange hashpartitioning(label")


def test_no_python_udfs_anywhere(spark):
    a = Analysis.from_tables(spark, SF001)
    for df in (a.summary(), a.histograms(), a.classified):
        plan = _plan(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_bucketed_roles_skip_shuffles(spark, no_broadcast):
    import uuid

    from stocklens.sources.roles import Roles

    a = Analysis.from_tables(spark, SF001)
    prefix = f"b{uuid.uuid4().hex[:6]}_"
    a.roles.save_tables(prefix, buckets=8)
    b = Analysis(Roles.from_tables(spark, prefix), SNAPSHOT, SEGMENT)
    plan = _plan(b.comparison)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # only the baseline moves (by product for the factor join, then into the
    # buckets) plus the factor itself; candidate, CoV and service do not
    assert len(exchanges) == 3, exchanges
    assert not any(e.startswith(("k_", "cv_", "sl_")) for e in exchanges)
    assert sorted(b.summary().collect()) == sorted(a.summary().collect())


def test_no_cross_products_in_headline_plans(spark):
    from stocklens.operators import compare, rollups

    a = Analysis.from_tables(spark, SF001)
    for df in (a.summary(), a.histograms(), rollups.scorecard(a.comparison),
               rollups.sums_card(a.comparison), a.scenario_pair(),
               compare.unmatched(a.roles, a.snapshot), a.classified):
        plan = _plan(df)
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_histogram_runs_the_joins_once(spark, no_broadcast):
    """H2: the values are written by one run of the four joins; both passes read that table, its one column."""
    from stocklens.operators import histogram, populations

    a = Analysis.from_tables(spark, SF001)
    spec = histogram.SPECS["hist_final_su"]
    existing = populations.existing(a.comparison)
    assert _plan(histogram.values(existing, {"h": spec})).count("SortMergeJoin") == 4
    got = a.histogram("hist_final_su")
    plan = _plan(got)
    assert "SortMergeJoin" not in plan and set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"v0:double"}
    lazy = histogram.spec_histogram(existing, spec)
    assert _plan(lazy).count("SortMergeJoin") > 4
    assert sorted(map(str, got.collect())) == sorted(map(str, lazy.collect()))
    assert "histogram-values" not in _plan(a.materialized().histograms())


def test_concatenated_key_shuffles_wide_rows_once(spark, no_broadcast):
    """No exchange holds a baseline column but the baseline's own; what is dealt by the string key is the candidate's side."""
    from stocklens.operators import compare

    a = Analysis.from_tables(spark, SF001)
    cmp = compare.comparison_concat_key(a.roles, a.snapshot)
    plan = _plan(cmp)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 7 and sum("_key" in k or "_ikey" in k for k in keys) == 2
    tree = plan.splitlines()
    joins = [(len(x) - len(x.lstrip(" :+-*(0123456789)")), x) for x in tree if "SortMergeJoin" in x]
    assert "_key" in min(joins)[1]  # the last join is the one with the baseline
    assert sorted(map(str, cmp.collect())) == sorted(map(str, a.comparison.collect()))
