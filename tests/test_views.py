"""The analysis as SQL text over views."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stocklens.operators import populations, rules
from stocklens.operators.rules import Thresholds
from stocklens.plans import views
from stocklens.plans.analysis import Analysis
from stocklens.sources import ingest


@pytest.fixture(scope="module")
def a(spark):
    return Analysis.from_tables(spark, SF001).materialized()


@pytest.fixture
def prefix():
    return f"v{uuid.uuid4().hex[:8]}_"


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_text_equals_the_dataframes(spark, a, prefix):
    a.comparison.createOrReplaceTempView(prefix + "comparison")
    names = views.create_views(spark, prefix)
    assert prefix + "summary" in names
    want = {
        "existing_in_both": populations.existing(a.comparison), "final_units": populations.final_units(a.comparison), "reco": populations.reco(a.comparison),
        "nonzero_candidate": populations.nonzero_candidate(a.comparison), "flagged": a.flagged, "classified": a.classified, "summary": a.summary(),
    }
    for name, df in want.items():
        got = spark.table(prefix + name)
        assert sorted(got.columns) == sorted(df.columns) and _rows(got) == _rows(df), name


def test_the_tree_equals_the_list_on_every_combination(spark, prefix):
    """Every band and its edges, nulls included, against the ordered rules."""
    values = {
        "cand_su": [None, 0.0, 5.0], "final_su": [0.0, 4.0, 50.0], "final_days": [None, -1.0, 3.0, 3.5, 7.0, 8.0], "transition_type": [None, "null", "PROMO"],
        "cand_weekly_cov": [None, 0.5, 0.6], "base_cov": [None, 0.55], "cfr": [None, 0.9, 0.97], "service_level": [None, 0.95],
        "stock": [None, 0.1, 1.0, 2.0, 12.0, 30.0], "final_su_diff": [None, 20.0, 21.0],
    }
    df = spark.range(1)
    for name, some in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(x).cast("string" if name == "transition_type" else "double") for x in some])))
    df = df.withColumns({"bucket_situational_cycle": F.col("stock"), "bucket_situational_safety": F.col("stock") * 0.2}).drop("id", "stock").repartition(8)
    df.createOrReplaceTempView(prefix + "comparison")
    t = Thresholds()
    for name in ("final_su", "flagged", "banded", "classified"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {prefix}{name} AS {views.view_texts(t)[name].format(p=prefix)}")
    want = rules.classify(rules.flags(df), t)
    keys = [*values.keys() - {"stock"}, "bucket_situational_cycle"]
    cols = [*keys, "label", "code", "cfr_on_target", "cand_cov_higher", "cycle_to_final_ratio"]
    got = spark.table(prefix + "classified").select(*cols)
    assert got.count() == want.count() > 80_000
    assert got.exceptAll(want.select(*cols)).isEmpty()
    assert {r.code for r in got.select("code").distinct().collect()} == set(range(1, 22))


def test_a_replaced_view_is_seen(spark, a, prefix):
    """Text looks names up anew at all levels; a DataFrame registered as a view does not."""
    a.comparison.createOrReplaceTempView(prefix + "comparison")
    views.create_views(spark, prefix)
    old = a.register_views(prefix + "plan_")
    total = spark.sql(f"SELECT sum(n_rows) FROM {prefix}summary").first()[0]
    few = a.comparison.filter("product < 'P15'")
    few.createOrReplaceTempView(prefix + "comparison")
    few.createOrReplaceTempView(prefix + "plan_comparison")
    left = spark.sql(f"SELECT sum(n_rows) FROM {prefix}summary").first()[0]
    assert left == populations.final_su(few).count() < total
    assert prefix + "plan_summary" in old and spark.sql(f"SELECT sum(n_rows) FROM {prefix}plan_summary").first()[0] == total
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {prefix}final_su AS SELECT * FROM {prefix}comparison WHERE final_su > 10")
    assert spark.sql(f"SELECT total_rows FROM {prefix}total_rows").first()[0] == few.filter("final_su > 10").count()
    assert spark.sql(f"SELECT sum(n_rows) FROM {prefix}summary").first()[0] == few.filter("final_su > 10").count()


def test_permanent_views_over_a_replaced_table(spark, a, prefix):
    ingest.replace_table(a.comparison, prefix + "comparison")
    names = views.create_views(spark, prefix, permanent=True)
    try:
        before = spark.table(prefix + "total_rows").first()[0]
        ingest.replace_table(a.comparison.filter("final_su > 10"), prefix + "comparison", allow_schema_change=False)
        assert 0 < spark.table(prefix + "total_rows").first()[0] < before
        assert {r.view: r.n for r in views.sizes(spark, names, prefix).collect()}["final_su"] == spark.table(prefix + "comparison").count()
    finally:
        for n in reversed(names):
            spark.sql(f"DROP VIEW IF EXISTS {n}")
        spark.sql(f"DROP TABLE IF EXISTS {prefix}comparison")


def test_filters_reach_the_scan(spark, a, prefix):
    a.comparison.createOrReplaceTempView(prefix + "comparison")
    views.create_views(spark, prefix)
    plan = spark.sql(f"SELECT code, count(*) FROM {prefix}classified WHERE subsector = 'PROMO' GROUP BY code")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subsector,PROMO)" in plan and "IsNotNull(final_su)" in plan and "cand_on_hand_cost" not in plan
