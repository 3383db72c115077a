"""Staged tables follow their inputs, for every form of path."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from stocklens.plans.analysis import Analysis
from stocklens.sources import fixture


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_changed_inputs_are_staged_again(spark, tmp_path, scheme):
    src = "/root/testdata/sf0.001"
    for name in ("supplier", "part"):
        os.symlink(f"{src}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines = spark.read.parquet(f"{src}/lineitem.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = f"{scheme}{tmp_path}"
    before = fixture.staged_pair(spark, sf).count()
    assert fixture.staged_pair(spark, sf).inputFiles() == fixture.staged_pair(spark, sf).inputFiles()
    lines.filter("l_partkey < 20").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    after = fixture.staged_pair(spark, sf).count()
    assert 0 < after < before
    assert fixture.cleanup(spark) >= 2
    assert fixture.staged_pair(spark, sf).count() == after


def _lines(spark, tmp_path):
    """Three tables with a part whose lines are many, keys that repeat or are null, and lines without part or supplier."""
    ids = spark.range(4000)
    line = ids.select(
        F.col("id").alias("l_orderkey"),
        F.when(F.col("id") % 97 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(300))).cast("long").alias("l_partkey"),
        F.when(F.col("id") % 89 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60))).cast("long").alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        F.element_at(F.array(*map(F.lit, "RAN")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"),
        F.make_date((F.col("id") % 4 + 1995).cast("int"), F.lit(3), F.lit(4)).cast("timestamp").alias("l_shipdate"),
    )
    part = spark.range(280).select(
        F.col("id").alias("p_partkey"), F.lit("ECONOMY").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (F.col("id") + 0.5).alias("p_retailprice")
    )
    part = part.unionByName(part.filter("p_partkey = 7"))
    nation = F.when(F.col("id") != 9, F.col("id") % 25).cast("int")
    supplier = spark.range(55).select(F.col("id").alias("s_suppkey"), nation.alias("s_nationkey"))
    for name, df in (("lineitem", line), ("part", part), ("supplier", supplier)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _same(one, two):
    return one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def _plain(spark, sf):
    """``pair`` as plain SQL."""
    for name in ("lineitem", "part", "supplier"):
        spark.read.parquet(f"{sf}/{name}.parquet").createOrReplaceTempView(f"staging_{name}")
    out = "SELECT p_partkey AS p, n, {y} qr, qa, dr, cn, p_type AS ty FROM (SELECT l_partkey, s_nationkey AS n, {y} " + ", ".join(
        f"sum(if(l_returnflag = '{f}', {c}, 0)) AS {a}" for f, c, a in (("R", "l_quantity", "qr"), ("A", "l_quantity", "qa"), ("R", "l_linenumber", "dr"))
    ) + ", count(*) AS cn FROM (SELECT *, year(l_shipdate) AS y FROM staging_lineitem) JOIN staging_supplier ON l_suppkey = s_suppkey GROUP BY ALL) JOIN staging_part ON l_partkey = p_partkey"
    return spark.sql(out.format(y="")), spark.sql(out.format(y="y,"))


@pytest.fixture
def many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fixture, "BUCKET_BYTES", 4000)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_buckets_spare_the_comparison_its_shuffles(spark, tmp_path, many_buckets):
    """Candidate, CoV and service level meet in the buckets; what is shuffled is the factor, and the baseline to it and back."""
    sf = _lines(spark, tmp_path)
    for limit in ("10485760", "-1"):  # part is broadcast, and not
        fixture.cleanup(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        staged = fixture.staged_pair(spark, sf)
        assert len({f.rsplit("_", 1)[1].split(".")[0] for f in staged.inputFiles()}) == len(staged.inputFiles()) > 3  # one file a bucket
        want, _ = _plain(spark, sf)
        assert _same(staged.select(want.columns), want)
        assert staged.filter("product <> concat('P', p) OR location <> concat('N', n)").isEmpty()
    a = Analysis.from_tables(spark, sf)
    plan = a.comparison._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 3 and not any(k.startswith(("k_", "cv_", "sl_")) for k in keys), keys
    assert _same(a.comparison, Analysis.from_tables(spark, sf, stage=False).comparison)
    name = fixture._table(fixture._STAGED[next(k for k in fixture._STAGED if k[1] == sf)])
    assert spark.catalog.tableExists(name)
    fixture.cleanup(spark)
    assert not spark.catalog.tableExists(name)


@pytest.mark.parametrize("by_year", [False, True])
def test_lines_are_dealt_before_they_are_combined(spark, tmp_path, by_year):
    """No hash table of nearly as many rows as lines stands before the shuffle, and one shuffle of the lines is enough."""
    sf = _lines(spark, tmp_path)
    plan = fixture.pair(spark, sf, by_year=by_year)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    assert "HashAggregate" not in plan[plan.index("Exchange hashpartitioning("):]
    want = _plain(spark, sf)[by_year]
    assert _same(fixture.pair(spark, sf, by_year=by_year, parts=5).select(want.columns), want)
