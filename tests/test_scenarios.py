"""Scenario selection, the two-scenario pair, previews."""

import pytest

from conftest import SF001
from stocklens.operators import scenarios
from stocklens.plans.analysis import Analysis


@pytest.fixture(scope="module")
def a(spark):
    return Analysis.from_tables(spark, SF001)


def test_pair_keeps_every_first_row(a):
    pair = a.scenario_pair()
    assert pair.count() == a.roles.candidate.count()
    matched = pair.filter("weekly_cov_2 IS NOT NULL").count()
    assert matched == a.roles.candidate2.count()


def test_pair_uses_on_hand_units(a):
    r = a.scenario_pair().orderBy("product", "location").first()
    src = a.roles.candidate.filter(
        f"PartName = '{r['product']}' AND PartSite = '{r['location']}'").first()
    assert r["stock_units_1"] == src["Avg_On_HandUnits"]


def test_first_ten_are_key_ordered(a):
    rows = scenarios.first_rows(a.scenario_pair(), 10, "product", "location").collect()
    keys = [(r["product"], r["location"]) for r in rows]
    assert len(rows) == 10 and keys == sorted(keys)


def test_select_scenario(a):
    cat = a.scenario_catalog()
    second = scenarios.select_scenario(cat, "second")
    assert second.count() == a.roles.candidate2.count()
    assert {r["scenario"] for r in second.select("scenario").distinct().collect()} == {"second"}
    with pytest.raises(KeyError):
        scenarios.select_scenario(cat, "third")
