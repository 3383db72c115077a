"""Traps of SURVEY section 1.1 not covered by the edge table."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions.arith import pct_diff, safe_div
from stocklens.operators import rollups
from stocklens.schema import BUCKET_NAMES


def test_t3_integer_inputs_give_double(spark):
    df = spark.createDataFrame([(5, 0), (3, 4), (0, 0)], "c bigint, b bigint")
    out = df.select(pct_diff("c", "b").alias("d"))
    assert out.schema["d"].dataType == T.DoubleType()
    assert [r["d"] for r in out.collect()] == [(5 - 0.01) / 0.01 * 100, -25.0, 0.0]


def test_t1_division_by_zero_is_null_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([(1.0, 0.0), (None, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, None, 0.5]


def test_t19_sum_of_sums_stays_null(spark):
    cols = ["stock_total"] + list(BUCKET_NAMES)
    rows = [tuple(1.0 for _ in cols), tuple(2.0 for _ in cols)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    df = df.withColumn("bucket_situational_cycle", F.lit(None).cast("double"))
    out = rollups.bucket_profile(df).first()
    assert out["situational_safety_su"] == 3.0
    assert out["situational_cycle_su"] is None
    assert out["situational_safety_and_cycle_su"] is None  # not coalesced to 3.0


def test_t9_nonzero_population_reads_recommended_units(spark):
    from stocklens.operators import populations

    df = spark.createDataFrame(
        [("a", None, 5.0, 8.0), ("b", 1.0, 5.0, None), ("c", 1.0, 0.0, 8.0)],
        "product string, reco_units double, cand_su double, final_units double",
    )
    got = {r["product"] for r in populations.nonzero_candidate(df).collect()}
    assert got == {"b"}  # a final value does not count; a recommended one does
