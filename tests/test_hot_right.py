"""Hot keys on the right side of the left joins."""

import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stocklens.operators.skew import heavy_keys, left_join
from stocklens.plans.analysis import Analysis


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def plain_shuffles(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _sides(spark, n=60_000):
    """A right side a third of whose rows have one key, all alike; another key is hot too, one is null."""
    left = spark.range(3000).select(F.concat(F.lit("P"), F.col("id") % 1500).alias("a"), (F.col("id") % 3).cast("string").alias("b"), "id")
    left = left.union(spark.sql("SELECT CAST(NULL AS STRING), '0', 7000L")).union(spark.sql("SELECT 'nowhere', '0', 7001L"))
    key = F.when(F.col("id") % 3 == 0, "P0").when(F.col("id") % 20 == 1, "P1").when(F.col("id") % 20 == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("P"), F.col("id") % 1500))
    right = spark.range(n).select(key.alias("x"), F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") % 3).cast("string")).alias("y"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    return left, right


def test_equal_rows_and_even_tasks(spark, plain_shuffles):
    left, right = _sides(spark)
    on = [("a", "x"), ("b", "y")]
    plain, split = left_join(left, right, on), left_join(left, right, on, rows=1000)
    assert _rows(split.groupBy("id", "x", "y", "v").count()) == _rows(plain.groupBy("id", "x", "y", "v").count())

    def largest(df):
        """Rows that the joins' tasks make: the largest against the median of those that make any."""
        made = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        return max(made) / statistics.median(made)

    assert largest(plain) > 8
    assert largest(split) < 3
    keys = {tuple(r)[:2] for r in heavy_keys(right, ["x", "y"], 1000).collect()}
    assert ("P0", "0") in keys and all(k[0] is not None for k in keys)


def test_no_hot_key_is_the_plain_plan(spark, plain_shuffles):
    left, right = _sides(spark, 900)
    split = left_join(left, right, [("a", "x"), ("b", "y")], rows=1000)
    assert split._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    with pytest.raises(ValueError, match="some number"):
        left_join(left, right, [("a", "x")], rows=0)


def test_comparison_and_pair(spark):
    a = Analysis.from_tables(spark, SF001)
    roles = a.roles
    hot = roles.cov.unionAll(roles.cov.limit(1).select("PRDID", "LOCID", F.explode(F.array([F.lit(float(k % 5)) for k in range(3000)])).alias("CV")))
    two = roles.candidate2.unionAll(roles.candidate2.orderBy("PartName", "PartSite").limit(1).crossJoin(spark.range(2000)).drop("id"))
    from dataclasses import replace

    more = replace(roles, cov=hot, candidate2=two)
    plain, split = Analysis(more, a.snapshot, a.segment), Analysis(more, a.snapshot, a.segment, hot_rows=300)
    assert _rows(split.comparison) == _rows(plain.comparison)
    assert _rows(split.scenario_pair()) == _rows(plain.scenario_pair())
    assert _rows(split.summary()) == _rows(plain.summary())
