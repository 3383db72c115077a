"""The reference counts of FIXTURES.md section 3.8 (sf0.01), reproduced.

The numbers are those of the oracle SQL in DuckDB, so they hold the Spark
results against it.
"""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from stocklens.operators import compare, histogram, populations, rollups, rules
from stocklens.plans.analysis import Analysis


@pytest.fixture(scope="module")
def a(spark):
    return Analysis.from_tables(spark, SF01)


@pytest.fixture(scope="module")
def card(a):
    return rollups.scorecard(a.comparison).first().asDict()


def test_role_sizes(a):
    r = a.roles
    target = r.baseline.filter(F.col("KEYFIGUREDATE") == F.lit(a.snapshot))
    got = [r.candidate.count(), target.count(), r.factor.count(), r.cov.count(),
           r.service.count(), r.candidate2.count()]
    assert got == [32146, 25646, 1907, 29641, 25679, 15784]


def test_comparison_and_populations(a, card):
    assert card["count_comparison"] == 32146
    assert compare.unmatched(a.roles, a.snapshot).count() == 6500
    assert card["count_final_su"] == 24558 and card["count_final"] == 22243
    assert populations.reco(a.comparison).count() == 19966
    assert card["count_nonzero"] == 6896
    assert a.comparison.filter(F.col("stock_total") == 0).count() == 1734
    assert a.segment_snapshot_count().first()["n"] == 3785


def test_decoy_snapshot_doubles_an_unfiltered_join(a):
    k, i = a.roles.candidate, a.roles.baseline
    joined = k.join(i, (k.PartName == i.PRDID) & (k.PartSite == i.LOCID), "left")
    assert joined.count() == 57792


def test_range_counts(card):
    assert (card["count_within20"], card["count_lower"], card["count_cycle_within20"]) == (
        6510, 11128, 5744)


def test_contingency_tables(card):
    assert (card["reco_nz_nz"], card["reco_nz_z"], card["reco_z_nz"], card["reco_z_z"]) == (
        4287, 2609, 7806, 5264)
    assert (card["final_nz_nz"], card["final_nz_z"], card["final_z_nz"], card["final_z_z"]) == (
        5097, 2965, 8568, 5613)


def test_histogram_inputs(a):
    got = {r["name"]: r["n"] for r in
           a.histograms().groupBy("name").agg(F.sum("n").alias("n")).collect()}
    assert [got[k] for k in ("hist_final_su", "hist_final_su_cycle", "hist_reco_su",
                             "hist_final_days", "hist_reco_days", "hist_cov")] == [
        20056, 18416, 17311, 21085, 20203, 22906]
    assert set(got) == set(histogram.SPECS)


def test_label_code_divergence(a):
    c = a.classified.filter(F.col("code") == 21)
    assert c.filter(F.col("label") == rules.LABELS[2]).count() == 524
    assert c.filter(F.col("label") == rules.LABELS[4]).count() == 758


def test_rows_per_code(a):
    got = {r["code"]: r["count"] for r in a.classified.groupBy("code").count().collect()}
    assert [got.get(c, 0) for c in range(1, 22)] == [
        6044, 1001, 1689, 1538, 1134, 1478, 312, 876, 143, 1607, 1534, 203, 427, 1288, 1370,
        29, 71, 271, 558, 561, 2424]


def test_scenario_pair(a):
    pair = a.scenario_pair()
    assert pair.count() == 32146
    assert pair.filter(F.col("direct_demand_2").isNotNull()).count() == 15784
