"""Edge table: one row per row-level trap and one per rule branch."""

import math

import pytest
from pyspark.sql import functions as F

from edge import OTHER_DAY, Case, roles
from stocklens.operators import compare, populations, rollups, rules
from stocklens.plans.analysis import Analysis
from stocklens.sources.fixture import SEGMENT, SNAPSHOT

CASES = [
    Case("E1", u=5.0, fac=2.0, b=8.0),
    Case("E2", u=5.0, fac=2.0, b=0.0),
    Case("E3", u=0.0, fac=2.0, b=0.0),
    Case("E4", u=None, fac=2.0, b=0.0),
    Case("E5", u=5.0, b=8.0, with_factor=False),
    Case("E6", u=5.0, fac=0.0, b=8.0),
    Case("E7", base=False),
    Case("E8", base_day=OTHER_DAY),
    Case("E9", u=5.0, fac=1.0, b=8.0, T=0.0),
    Case("E10", u=0.0, b=8.0, d=3.0, tr="null"),
    Case("E11a", u=0.0, b=8.0, d=3.0, tr=None, cov=None),
    Case("E11b", u=0.0, b=8.0, d=7.0, tr=None, cov=None),
    Case("E11c", u=0.0, b=8.0, d=7.5, tr=None, cov=None),
    Case("E12", cfr=0.9, sl=None),
    Case("E13", cfr=0.9, sl=0.9),
    Case("E14a", cov=None, cv=0.5),
    Case("E14b", cov=0.9, cv=None),
    Case("E15a", u=12.0, b=10.0),  # diff exactly +20
    Case("E15b", u=8.0, b=10.0),   # diff exactly -20
    Case("E16a", u=11.0, b=10.0, B=1.0, C=1.0),  # ratio exactly 0.2
    Case("E16b", u=5.0, b=10.0, B=2.0, C=2.0, cov=0.9, cfr=0.95),  # ratio exactly 0.4
    Case("E17", extra_factor=True),
]

# One case per rule branch (code, case). Factor 1 so candidate SU = units.
RULE_CASES = [
    (1, Case("R1", u=0.0, b=0.0)),
    (2, Case("R2", u=0.0, b=10.0, d=2.0, tr="PROMO")),
    (3, Case("R3", u=0.0, b=10.0, d=2.0, tr=None)),
    (4, Case("R4", u=0.0, b=10.0, d=5.0, tr="PROMO")),
    (5, Case("R5", u=0.0, b=10.0, d=5.0, tr=None, cov=0.3)),
    (6, Case("R6", u=0.0, b=10.0, d=5.0, tr=None, cov=0.9)),
    (7, Case("R7", u=0.0, b=10.0, d=10.0, cov=None)),
    (8, Case("R8", u=0.0, b=10.0, d=10.0, cov=0.9)),
    (9, Case("R9", u=11.0, b=10.0)),
    (10, Case("R10", u=20.0, b=10.0, cov=0.1, cv=0.5)),
    (11, Case("R11", u=20.0, b=10.0, cov=0.9, cv=0.5)),
    (12, Case("R12", u=20.0, b=10.0, B=3.0, cfr=0.95, sl=0.9)),
    (13, Case("R13", u=20.0, b=10.0, B=3.0, cfr=0.85, sl=0.9)),
    (20, Case("R20a", u=20.0, b=10.0, B=3.0, cfr=None)),
    (14, Case("R14", u=20.0, b=10.0, B=5.0)),
    (15, Case("R15", u=5.0, b=10.0, cov=0.1, cv=0.5)),
    (16, Case("R16", u=5.0, b=10.0, cov=0.9, cv=0.5, B=5.0, cfr=0.95, sl=0.9)),
    (17, Case("R17", u=5.0, b=10.0, cov=0.9, cv=0.5, B=5.0, cfr=0.85, sl=0.9)),
    (20, Case("R20b", u=5.0, b=10.0, cov=0.9, cv=0.5, B=5.0, cfr=None)),
    (18, Case("R18", u=5.0, b=10.0, cov=0.9, cv=0.5, B=3.0, cfr=0.95, sl=0.9)),
    (19, Case("R19", u=5.0, b=10.0, cov=0.9, cv=0.5, B=3.0, cfr=0.85, sl=0.9)),
    (20, Case("R20c", u=5.0, b=10.0, cov=0.9, cv=0.5, B=3.0, cfr=None)),
    (21, Case("R21", u=None, b=10.0)),
]


@pytest.fixture(scope="module")
def analysis(spark):
    return Analysis(roles(spark, CASES + [c for _, c in RULE_CASES]), SNAPSHOT, SEGMENT)


@pytest.fixture(scope="module")
def rows(analysis):
    out = {}
    for r in analysis.comparison.collect():
        out.setdefault(r["product"], []).append(r.asDict())
    return out


@pytest.fixture(scope="module")
def classes(analysis):
    return {r["product"]: r.asDict() for r in analysis.classified.collect()}


def one(rows, name):
    assert len(rows[name]) == 1, rows[name]
    return rows[name][0]


def test_e1_plain_diff(rows):
    assert one(rows, "E1")["final_su_diff"] == 25.0


def test_e2_zero_base_uses_pseudo_base(rows):
    assert one(rows, "E2")["final_su_diff"] == pytest.approx(99900.0)


def test_e3_both_zero(rows, classes):
    assert one(rows, "E3")["final_su_diff"] == 0.0
    assert classes["E3"]["code"] == 1


def test_e4_null_candidate(rows, classes):
    assert one(rows, "E4")["final_su_diff"] is None
    assert classes["E4"]["code"] == 21


def test_e5_missing_factor(analysis, rows, classes):
    r = one(rows, "E5")
    assert r["final_units"] is None and r["cand_su"] is None
    v1 = {x["product"] for x in populations.final_units(analysis.comparison).collect()}
    v2 = {x["product"] for x in populations.final_su(analysis.comparison).collect()}
    assert "E5" in v2 and "E5" not in v1
    assert classes["E5"]["code"] == 21


def test_e6_zero_factor_no_error(rows):
    r = one(rows, "E6")
    assert r["final_units"] is None
    assert r["cand_su"] == 0.0


@pytest.mark.parametrize("name", ["E7", "E8"])
def test_e7_e8_unmatched(analysis, rows, name):
    r = one(rows, name)
    for c in ("base_product", "base_location", "final_su", "reco_su", "final_days", "factor"):
        assert r[c] is None
    lone = {x["product"] for x in compare.unmatched(analysis.roles, SNAPSHOT).collect()}
    assert name in lone
    assert lone == {"E7", "E8"}


def test_e9_zero_total_stock(rows):
    r = one(rows, "E9")
    assert r["cycle_ratio"] is None
    assert r["final_su_cycle_diff"] is None


def test_e10_label_code_divergence(classes):
    r = classes["E10"]
    assert r["label"] == rules.LABELS[2]
    assert r["code"] == 21


@pytest.mark.parametrize("name,code", [("E11a", 3), ("E11b", 5), ("E11c", 7)])
def test_e11_days_bands(classes, name, code):
    assert classes[name]["code"] == code


def test_e12_no_service_level(classes):
    assert classes["E12"]["cfr_on_target"] == "no info about CFR"


def test_e13_equal_service_is_no(classes):
    assert classes["E13"]["cfr_on_target"] == "NO"


@pytest.mark.parametrize("name", ["E14a", "E14b"])
def test_e14_null_cov_flag_no(classes, name):
    assert classes[name]["cand_cov_higher"] == "NO"


def test_e15_inclusive_range(analysis, rows, classes):
    assert one(rows, "E15a")["final_su_diff"] == 20.0
    assert one(rows, "E15b")["final_su_diff"] == -20.0
    inside = {
        r["product"]
        for r in analysis.comparison.filter(F.col("final_su_diff").between(-20, 20)).collect()
    }
    assert {"E15a", "E15b"} <= inside
    assert classes["E15a"]["code"] == 9


def test_e16_ratio_boundaries(classes):
    assert classes["E16a"]["cycle_to_final_ratio"] == 0.2
    assert classes["E16a"]["code"] == 9  # the r <= 0.2 branch
    assert classes["E16b"]["cycle_to_final_ratio"] == 0.4
    assert classes["E16b"]["code"] == 18  # r <= 0.4 branch of the lower ladder


def test_e17_duplicate_factor_fans_out(rows):
    assert len(rows["E17"]) == 2


@pytest.mark.parametrize("code,case", RULE_CASES, ids=[c.name for _, c in RULE_CASES])
def test_e22_rule_branches(classes, code, case):
    r = classes[case.name]
    assert r["code"] == code
    assert r["label"] == rules.LABELS[code]


def test_shared_labels(classes):
    assert classes["R9"]["label"] == classes["R13"]["label"]
    assert classes["R20a"]["label"] == classes["R20b"]["label"] == classes["R20c"]["label"]


def test_summary_shares(analysis):
    out = analysis.summary().collect()
    assert math.isclose(sum(r["pct_rows"] for r in out), 100.0)
    assert sum(r["n_rows"] for r in out) == analysis.final.count()
    shares = [r["pct_su"] for r in out]
    assert shares == sorted(shares, key=lambda x: (x is None, -(x or 0)))


def test_scorecard_equals_individual_counts(analysis):
    card = rollups.scorecard(analysis.comparison).first().asDict()
    for key in rollups.COUNT_KEYS:
        assert card[key] == rollups.count(analysis.comparison, key).first()["n"], key
