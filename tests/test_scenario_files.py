"""Scenarios by path."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stocklens.operators.scenarios import ScenarioFiles
from stocklens.plans.analysis import Analysis


@pytest.fixture(scope="module")
def a(spark):
    return Analysis.from_tables(spark, SF001)


@pytest.fixture(scope="module")
def files(spark, a, tmp_path_factory):
    root = tmp_path_factory.mktemp("scenarios")
    raw = a.roles.candidate.withColumnRenamed("Safety_StockUnits", "Safety StockUnits").withColumn("Note", F.lit(1))
    raw.write.parquet(f"{root}/first")
    a.roles.candidate2.withColumn("note", F.lit(2.5)).withColumn("Plan.Week", F.lit("w")).write.parquet(f"{root}/second")
    a.roles.candidate2.withColumn("Note", F.lit("text")).write.parquet(f"{root}/third")
    return ScenarioFiles(spark, {"first": f"{root}/first", "second": f"{root}/second", "third": f"{root}/third", "gone": f"{root}/no-such-folder"})


def _scans(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]


def test_one_path_is_listed_and_scanned(a, files):
    """The catalog also names a folder that does not exist: selecting another scenario never looks there."""
    second = files.select("second")
    (scan,) = _scans(second)
    assert "second" in scan and "first" not in scan
    assert second.count() == a.roles.candidate2.count()
    assert {r[0].rsplit("/", 2)[1] for r in second.select("source_file").distinct().collect()} == {"second"}
    assert second.columns[-4:] == ["note", "Plan.Week", "scenario", "source_file"]
    with pytest.raises(KeyError, match="unknown scenario"):
        files.select("fourth")
    with pytest.raises(Exception, match="no-such-folder"):
        files.select("gone")


def test_merged_by_name(a, files):
    both = files.merged(["first", "second"])
    assert dict(both.dtypes)["Note"] == "double" and "Safety_StockUnits" in both.columns and both.columns[-2:] == ["scenario", "source_file"]
    seen = {(r.scenario, r.Note, r.week): r.n for r in both.groupBy("scenario", "Note", F.col("`Plan.Week`").alias("week")).agg(F.count("*").alias("n")).collect()}
    assert seen == {("first", 1.0, None): a.roles.candidate.count(), ("second", 2.5, "w"): a.roles.candidate2.count()}
    only = both.filter("scenario = 'second'")
    assert len(_scans(only)) == 1 and "second" in _scans(only)[0]
    with pytest.raises(ValueError, match="Note is double in scenario second and string in third|note is double in scenario second and string in third"):
        files.merged(["second", "third"])
    with pytest.raises(ValueError, match="no scenario"):
        files.merged([])


def test_analysis_and_pair_of_a_scenario(a, files):
    chosen = Analysis(a.roles.with_candidate(files.select("second").drop("scenario", "source_file")), a.snapshot, a.segment)
    assert chosen.comparison.count() == a.roles.candidate2.count() and "Plan.Week" in chosen.classified.columns
    assert files.pair("first", "second").count() == a.roles.candidate.count()
    with pytest.raises(ValueError, match="missing columns"):
        ScenarioFiles(files.spark, files.paths, schema=a.roles.baseline.schema).select("first")
