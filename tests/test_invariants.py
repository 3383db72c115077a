"""Invariants of the analysis on the driver tables."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stocklens.operators import compare, histogram, populations, rollups, rules
from stocklens.plans.analysis import Analysis
from stocklens.sources import fixture
from stocklens.sources.fixture import SEGMENT, SNAPSHOT


@pytest.fixture(scope="module")
def a(spark):
    return Analysis.from_tables(spark, SF001)


@pytest.fixture(scope="module")
def card(a):
    return rollups.scorecard(a.comparison).first().asDict()


def test_comparison_keeps_every_candidate_row(a, card):
    # right-side keys are unique in the fixture, so no fan-out
    assert card["count_comparison"] == a.roles.candidate.count()


def test_matched_plus_unmatched(a, card):
    matched = a.comparison.filter(F.col("base_product").isNotNull()).count()
    lone = compare.unmatched(a.roles, a.snapshot).count()
    assert card["count_comparison"] == matched + lone


def test_has_final_views_agree(card):
    assert card["count_has_final"] == card["count_existing"] == card["count_final_su"]


def test_class_counts_sum_to_population(a, card):
    per_code = a.classified.groupBy("code").count().collect()
    assert sum(r["count"] for r in per_code) == card["count_final_su"]
    assert {r["code"] for r in per_code} <= set(range(1, 22))


def test_label_code_divergence_only_for_literal_null(a):
    bad = (
        a.classified.select(
            "transition_type", "code",
            rules.label_of(rules.fold(rules.rule_list(rules.label_present))).alias("lc_label"),
            "label",
        )
        .filter(F.col("label") != rules.label_of(F.col("code")))
        .collect()
    )
    assert bad, "fixture should contain literal 'null' transition types"
    assert all(r["transition_type"] == "null" and r["code"] == 21 for r in bad)
    assert {r["label"] for r in bad} <= {rules.LABELS[2], rules.LABELS[4]}


def test_shares_sum_to_100(a):
    out = a.summary().collect()
    for col in ("pct_rows", "pct_su", "pct_usd"):
        assert math.isclose(sum(r[col] for r in out), 100.0, rel_tol=1e-9), col


def test_contingency_partitions_population(a):
    for which, pop in (("reco", populations.reco), ("final", populations.final_units)):
        cells = rollups.contingency(a.comparison, which).collect()
        assert sum(r["n"] for r in cells) == pop(a.comparison).count()


def test_zero_nonzero_counts_partition(card):
    assert card["reco_nz_z"] + card["reco_nz_nz"] == card["reco_cand_nz"]
    assert card["final_nz_z"] + card["final_nz_nz"] == card["final_cand_nz"]
    assert (card["final_z_nz"] + card["final_z_z"] + card["final_cand_nz"]) <= card["count_final"]


@pytest.mark.parametrize("name", sorted(histogram.SPECS))
def test_histogram_counts_sum_to_filtered_rows(a, name):
    spec = histogram.SPECS[name]
    hist = a.histogram(name).collect()
    assert len(hist) == spec.bins
    filtered = histogram.in_range(populations.existing(a.comparison), spec.column,
                                  spec.lower, spec.upper).count()
    assert sum(r["n"] for r in hist) == filtered


def test_concat_key_join_equals_composite_join(a):
    x = compare.comparison_concat_key(a.roles, a.snapshot)
    assert x.exceptAll(a.comparison).count() == 0
    assert a.comparison.exceptAll(x).count() == 0


def test_staged_roles_equal_lazy_roles(spark, a):
    lazy = fixture.fixture_roles(spark, SF001)
    for name, df in a.roles.items():
        other = getattr(lazy, name)
        assert df.exceptAll(other).count() == 0 and other.exceptAll(df).count() == 0, name


def test_snapshot_filter_reaches_the_scan(a):
    plan = a.comparison._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan


def test_materialized_comparison_gives_same_summary(a):
    m = a.materialized()
    assert sorted(m.summary().collect()) == sorted(a.summary().collect())


def test_timestamp_snapshot_matches_whole_day(spark):
    import datetime as dt

    df = spark.createDataFrame(
        [(dt.datetime(2001, 12, 31, 10, 0),), (dt.datetime(2002, 1, 1, 0, 0),)], "ts timestamp"
    )
    pred = compare.snapshot_predicate(df, "ts", dt.date(2001, 12, 31))
    assert df.filter(pred).count() == 1


def test_sql_views(spark, a):
    names = a.register_views("t_")
    assert "t_summary" in names
    n = spark.sql("SELECT COUNT(*) AS n FROM t_final_su").first()["n"]
    assert n == a.final.count()
    by_sql = spark.sql(
        "SELECT label, COUNT(*) AS n_rows FROM t_classified GROUP BY label").collect()
    by_df = rollups.class_rollup(a.classified).select("label", "n_rows").collect()
    assert sorted(by_sql) == sorted(by_df)


def test_timestamp_ntz_snapshot_matches_whole_day(spark):
    import datetime as dt

    df = spark.createDataFrame(
        [(dt.datetime(2001, 12, 31, 23, 59),), (dt.datetime(2001, 12, 30, 23, 59),)],
        "ts timestamp_ntz",
    )
    pred = compare.snapshot_predicate(df, "ts", dt.date(2001, 12, 31))
    assert df.filter(pred).count() == 1


def test_concat_key_separator_keeps_keys_apart(spark):
    from edge import Case, roles as make_roles
    from stocklens.sources.roles import Roles

    r = make_roles(spark, [Case("A1")])
    # same text once product and location are glued together without separator
    cand = r.candidate.selectExpr("'A1' AS PartName", "'23' AS PartSite",
                                  *[c for c in r.candidate.columns[2:]])
    base = r.baseline.selectExpr("'A12' AS PRDID", "'3' AS LOCID", *r.baseline.columns[2:])
    rr = Roles(cand, base, r.factor, r.cov, r.service)
    import datetime as dt
    out = compare.comparison_concat_key(rr, dt.date(2001, 12, 31)).collect()
    assert len(out) == 1 and out[0]["base_product"] is None


def test_numeric_keys_compare_as_text(spark):
    import datetime as dt

    from edge import Case, roles as make_roles
    from stocklens.sources.roles import Roles

    r = make_roles(spark, [Case("x")])
    rest = r.candidate.columns[2:]
    cand = r.candidate.selectExpr("CAST(1 AS BIGINT) AS PartName", "PartSite", *rest).union(
        r.candidate.selectExpr("CAST(2 AS BIGINT) AS PartName", "PartSite", *rest))
    brest = r.baseline.columns[1:]
    base = r.baseline.selectExpr("'001' AS PRDID", *brest).union(
        r.baseline.selectExpr("'2' AS PRDID", *brest))
    rr = Roles(cand, base, r.factor, r.cov, r.service)
    got = {row["product"]: row["base_product"]
           for row in compare.comparison(rr, dt.date(2001, 12, 31)).collect()}
    assert got == {"1": None, "2": "2"}  # '001' is not 1 as text


def test_written_roles_prune_baseline_partitions(spark, a, tmp_path):
    from stocklens.sources.roles import Roles

    path = str(tmp_path / "roles")
    a.roles.write(path)
    back = Analysis(Roles.read(spark, path), SNAPSHOT, SEGMENT)
    plan = back.comparison._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(KEYFIGUREDATE" in plan
    assert sorted(back.summary().collect()) == sorted(a.summary().collect())


def test_sums_card_equals_separate_queries(a):
    card = rollups.sums_card(a.comparison).first().asDict()
    for name, fn in {
        "totals_existing": rollups.totals_existing,
        "totals_su_nonzero": rollups.totals_su_nonzero,
        "totals_units": rollups.totals_units,
        "buckets_nonzero": rollups.buckets_nonzero,
        "buckets_all": rollups.buckets_all,
        "bucket_reconcile": rollups.bucket_reconcile,
    }.items():
        for col, value in fn(a.comparison).first().asDict().items():
            assert card[f"{name}__{col}"] == value, (name, col)
