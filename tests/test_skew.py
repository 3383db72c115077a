"""A product holding a third of all rows: AQE splits it, results unchanged."""

import datetime as dt

from pyspark.sql import functions as F

from stocklens import schema as S
from stocklens.plans.analysis import Analysis
from stocklens.sources.fixture import SEGMENT, SNAPSHOT
from stocklens.sources.roles import Roles

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
}


def _skewed_roles(spark, n=90_000):
    product = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
        F.concat(F.lit("P"), (F.col("id") % 3000).cast("string")))
    cand = spark.range(n).select(
        product.alias("PartName"),
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("PartSite"),
        *[F.floor(F.rand(i) * 100).alias(c) for i, c in
          enumerate(S.candidate_schema().fieldNames()[2:])],
    )
    doubles = [f.name for f in S.baseline_schema().fields
               if f.dataType.simpleString() == "double"]
    base = cand.select(
        F.col("PartName").alias("PRDID"), F.col("PartSite").alias("LOCID"),
        F.lit(dt.date(2001, 12, 31)).alias("KEYFIGUREDATE"),
        F.lit("X").alias("PGSUBSECTOR"), F.lit(None).cast("string").alias("PGTRANSITIONTYPE"),
        *[F.floor(F.rand(100 + i) * 100).cast("double").alias(c) for i, c in enumerate(doubles)],
    ).select(*S.baseline_schema().fieldNames())
    factor = spark.range(3000).select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("Material"),
        F.lit(2.0).alias("converter_factor"),
    ).union(spark.createDataFrame([("HOT", 4.0)], S.factor_schema()))
    cov = cand.select(F.col("PartName").alias("PRDID"), F.col("PartSite").alias("LOCID"),
                      F.lit(0.5).alias("CV"))
    sl = cand.select(F.col("PartName").alias("PRDID"), F.col("PartSite").alias("LOCID"),
                     F.lit(0.9).alias("Service_Level"))
    return Roles(cand, base, factor, cov, sl)


def test_hot_product_is_split_and_result_unchanged(spark):
    # written once, so both runs read identical inputs
    paths = _paths(spark, _skewed_roles(spark))
    expected = sorted(
        tuple(r) for r in Analysis(_read(spark, paths), SNAPSHOT, SEGMENT).summary().collect()
    )

    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        b = Analysis(_read(spark, paths), SNAPSHOT, SEGMENT)
        df = b.summary()
        got = sorted(tuple(r) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    for g, e in zip(got, expected):
        for x, y in zip(g[2:], e[2:]):
            assert abs(x - y) <= 1e-9 * max(1.0, abs(y))


def _read(spark, paths):
    return Roles(*[spark.read.parquet(p) for p in paths])


def _paths(spark, roles):
    from stocklens.session import scratch_path

    out = []
    for name, df in roles.items():
        p = scratch_path(spark, f"skew-{name}")
        df.write.parquet(p)
        out.append(p)
    return out


def _hot_matloc_roles(spark, n=90_000):
    """A third of the candidate rows on one (product, location)."""
    site = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(
        F.concat(F.lit("L"), F.col("id").cast("string")))
    prod = F.when(F.col("id") % 3 == 0, F.lit("HOTP")).otherwise(
        F.concat(F.lit("P"), (F.col("id") % 3000).cast("string")))
    cand = spark.range(n).select(
        prod.alias("PartName"), site.alias("PartSite"),
        *[F.floor(F.rand(i) * 100).alias(c) for i, c in
          enumerate(S.candidate_schema().fieldNames()[2:])],
    )
    keys = cand.select("PartName", "PartSite").distinct()
    doubles = [f.name for f in S.baseline_schema().fields
               if f.dataType.simpleString() == "double"]
    base = keys.select(
        F.col("PartName").alias("PRDID"), F.col("PartSite").alias("LOCID"),
        F.lit(dt.date(2001, 12, 31)).alias("KEYFIGUREDATE"),
        F.lit("X").alias("PGSUBSECTOR"), F.lit(None).cast("string").alias("PGTRANSITIONTYPE"),
        *[F.floor(F.rand(100 + i) * 100).cast("double").alias(c) for i, c in enumerate(doubles)],
    ).select(*S.baseline_schema().fieldNames())
    factor = spark.range(3000).select(
        F.concat(F.lit("P"), F.col("id").cast("string")).alias("Material"),
        F.lit(2.0).alias("converter_factor"),
    ).union(spark.createDataFrame([("HOTP", 4.0)], S.factor_schema()))
    cov = keys.select(F.col("PartName").alias("PRDID"), F.col("PartSite").alias("LOCID"),
                      F.lit(0.5).alias("CV"))
    sl = keys.select(F.col("PartName").alias("PRDID"), F.col("PartSite").alias("LOCID"),
                     F.lit(0.9).alias("Service_Level"))
    return Roles(cand, base, factor, cov, sl)


def test_hot_matloc_is_split_when_forced(spark):
    # The three (product, location) joins share one partitioning, so AQE
    # splits a hot candidate key there only when allowed an extra shuffle.
    paths = _paths(spark, _hot_matloc_roles(spark))
    expected = sorted(tuple(r) for r in Analysis(_read(spark, paths), SNAPSHOT, SEGMENT).summary().collect())
    conf = dict(SKEW_CONF, **{"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"})
    saved = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = Analysis(_read(spark, paths), SNAPSHOT, SEGMENT).summary()
        got = sorted(tuple(r) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true) [k_product" in plan
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    for g, e in zip(got, expected):
        for x, y in zip(g[2:], e[2:]):
            assert abs(x - y) <= 1e-9 * max(1.0, abs(y))
