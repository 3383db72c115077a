"""Undeclared columns of both sides reach the comparison and all that is built on it."""

import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stocklens import schema as S
from stocklens.operators import compare, populations
from stocklens.operators.compare import ColumnClash
from stocklens.plans.analysis import Analysis
from stocklens.sources.roles import Roles


@pytest.fixture(scope="module")
def a(spark):
    return Analysis.from_tables(spark, SF001)


def _with(a, k=(), i=()):
    cand, base = a.roles.candidate, a.roles.baseline
    for c in k:
        cand = cand.withColumn(c, F.concat_ws("-", "PartName", "PartSite"))
    for c in i:
        base = base.withColumn(c, F.concat_ws("+", "PRDID", "LOCID"))
    return Analysis(replace(a.roles, candidate=cand, baseline=base), a.snapshot, a.segment)


def test_columns_of_both_sides_travel(a):
    more = _with(a, k=["Note", "Lead.Time (days)", "odd`name"], i=["Review Round"])
    extra = ["Note", "Lead.Time (days)", "odd`name", "Review Round"]
    cmp = more.comparison
    assert cmp.columns == compare.COLUMNS + extra
    rows = cmp.select("product", "location", "base_product", "base_location", *[S.quoted(c) for c in extra]).collect()
    assert len(rows) == a.comparison.count()
    for r in rows:
        assert r["Note"] == r["Lead.Time (days)"] == r["odd`name"] == f"{r['product']}-{r['location']}"
        assert r["Review Round"] == (None if r["base_product"] is None else f"{r['base_product']}+{r['base_location']}")
    for df in (populations.reco(cmp), more.flagged, more.classified, compare.unmatched(more.roles, a.snapshot), compare.comparison_concat_key(more.roles, a.snapshot)):
        assert set(extra) <= set(df.columns)
    assert more.classified.select("Note", "label").count() == a.classified.count()
    lone = compare.unmatched(more.roles, a.snapshot).select("Note", F.col("`Review Round`").alias("r")).collect()
    assert lone and all(r["Note"] and r["r"] is None for r in lone)


@pytest.mark.parametrize(
    ("k", "i", "said"),
    [
        (["note"], ["Note"], "candidate.note and baseline.Note"),
        (["Label"], [], "comparison's label and candidate.Label"),
        ([], ["final_su_diff"], "comparison's final_su_diff and baseline.final_su_diff"),
    ],
)
def test_a_clash_names_both(a, k, i, said):
    with pytest.raises(ColumnClash, match=said):
        _with(a, k, i)


def test_unused_columns_are_pruned(spark, a, tmp_path):
    """Carried columns are not read where a result does not use them."""
    more = _with(a, k=["Note"], i=["Review"])
    more.roles.write(str(tmp_path / "roles"))
    back = Analysis(Roles.read(spark, str(tmp_path / "roles")), a.snapshot, a.segment)
    assert {"Note", "Review"} <= set(back.classified.columns)
    plan = back.summary()._jdf.queryExecution().executedPlan().toString()
    assert "Note" not in plan and "Review" not in plan
    assert back.classified.select("Note").distinct().count() == more.classified.select("Note").distinct().count()


def test_tables_and_conform_keep_them(spark, a):
    prefix = f"star{uuid.uuid4().hex[:6]}_"
    more = _with(a, k=["Note"])
    more.roles.save_tables(prefix, buckets=2)
    try:
        assert "Note" in Roles.from_tables(spark, prefix).candidate.columns
    finally:
        for role, _ in more.roles.items():
            spark.sql(f"DROP TABLE IF EXISTS {prefix}{role}")
    other = more.roles.candidate.withColumnRenamed("PartName", "sku")
    named = replace(more.roles, candidate=other, candidate2=None).conform(candidate=S.CandidateCols(product="sku"))
    assert "Note" in named.candidate.columns and "PartName" in named.candidate.columns
    with pytest.raises(ValueError, match="partname"):
        replace(more.roles, candidate=other.withColumn("PartName", F.lit("x")), candidate2=None).conform(candidate=S.CandidateCols(product="sku"))
