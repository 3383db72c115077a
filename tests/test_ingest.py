"""Ingest: header normalisation, NaN -> NULL, role scans, table writes."""

import os
import tempfile

import pytest

from stocklens import schema as S
from stocklens.sources import ingest
from stocklens.sources.fixture import SEGMENT, SNAPSHOT
from stocklens.sources.roles import Roles


def test_normalize_header_rules():
    assert ingest.normalize_header("Part Name") == "Part_Name"
    assert ingest.normalize_header("Safety Stock\n(Units)") == "Safety_StockUnits"
    assert ingest.normalize_header("Cost ($)") == "Cost_USD_"
    assert ingest.normalize_header("a;b,{c}") == "abc"
    assert ingest.normalize_header("c.d") == "c.d"
    assert ingest.normalize_header("x\ty") == "xy"


def _raw_csv(rows, header):
    d = tempfile.mkdtemp(prefix="stocklens-raw-")
    path = os.path.join(d, "raw.csv")
    import csv

    with open(path, "w", newline="") as fh:
        w = csv.writer(fh, lineterminator="\n")
        w.writerow(header)
        w.writerows(rows)
    return path


def test_raw_file_fixture(spark):
    header = ["Part Name", "Safety Stock\n(Units)", "Cost ($)", "a;b,{c}", "c.d"]
    path = _raw_csv([["001", "5.0", "1.5", "0.0", "t"], ["X1", "NaN", "", "2.0", ""]], header)
    schema = None
    df = ingest.scan_role(spark, path, schema, fmt="csv", header="true", multiLine="true",
                          inferSchema="false")
    assert df.columns == ["Part_Name", "Safety_StockUnits", "Cost_USD_", "abc", "c.d"]
    typed = df.selectExpr(
        "Part_Name", "CAST(Safety_StockUnits AS DOUBLE) AS Safety_StockUnits",
        "CAST(Cost_USD_ AS DOUBLE) AS Cost_USD_",
    )
    rows = ingest.nan_to_null(typed).orderBy("Part_Name").collect()
    assert rows[0]["Part_Name"] == "001"  # stays a string
    assert rows[0]["Safety_StockUnits"] == 5.0
    assert rows[1]["Safety_StockUnits"] is None  # NaN -> NULL
    assert rows[1]["Cost_USD_"] is None


def test_header_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, a_b int")
    with pytest.raises(ingest.HeaderCollision):
        ingest.normalize_headers(df)


def test_e21_nan_to_null_only_float_columns(spark):
    df = spark.createDataFrame([("x", float("nan"), 1), ("y", 2.0, 2)], "k string, v double, n int")
    out = {r["k"]: r for r in ingest.nan_to_null(df).collect()}
    assert out["x"]["v"] is None and out["y"]["v"] == 2.0
    assert ingest.nan_to_null(df).schema == df.schema


def test_scan_role_casts_to_declared_schema(spark, tmp_path):
    rows = [("P1", "N1", "5", "2")]
    df = spark.createDataFrame(rows, "PartName string, PartSite string, "
                                     "Safety_StockUnits string, Safety_StockDays string")
    for c in S.candidate_schema().fieldNames()[4:]:
        df = df.selectExpr("*", f"'1.5' AS {c}")
    path = str(tmp_path / "cand")
    df.write.parquet(path)
    out = ingest.scan_role(spark, path, S.candidate_schema())
    assert out.schema == S.candidate_schema()
    assert out.first()["Safety_StockUnits"] == 5.0


def test_scan_role_missing_column(spark, tmp_path):
    path = str(tmp_path / "bad")
    spark.createDataFrame([("P1",)], "PartName string").write.parquet(path)
    with pytest.raises(ValueError):
        ingest.scan_role(spark, path, S.candidate_schema())


def test_write_table_overwrite_and_schema_guard(spark):
    name = "stocklens_t_factor"
    a = spark.createDataFrame([("P1", 1.0)], S.factor_schema())
    ingest.write_table(a, name, allow_schema_change=False)
    b = spark.createDataFrame([("P2", 2.0), ("P3", 3.0)], S.factor_schema())
    ingest.write_table(b, name, allow_schema_change=False)
    assert sorted(r[0] for r in ingest.read_table(spark, name).collect()) == ["P2", "P3"]
    changed = spark.createDataFrame([("P4", "x")], "Material string, converter_factor string")
    with pytest.raises(ValueError):
        ingest.write_table(changed, name, allow_schema_change=False)
    ingest.write_table(changed, name, allow_schema_change=True)
    assert ingest.read_table(spark, name).schema["converter_factor"].dataType.simpleString() == "string"


def test_roles_round_trip(spark, tmp_path):
    from edge import Case, roles

    r = roles(spark, [Case("A"), Case("B", base=False)])
    r = Roles(r.candidate, r.baseline, r.factor, r.cov, r.service, r.candidate)
    r.write(str(tmp_path / "roles"))
    back = Roles.read(spark, str(tmp_path / "roles"))
    for name, df in r.items():
        assert sorted(getattr(back, name).collect()) == sorted(df.collect()), name


def test_scan_role_nan_text_becomes_null_after_cast(spark, tmp_path):
    path = str(tmp_path / "fac.csv")
    with open(path, "w") as fh:
        fh.write("Material,converter factor\nP1,NaN\nP2,2.5\n")
    out = ingest.scan_role(spark, path, S.factor_schema(), fmt="csv", header="true")
    assert out.schema == S.factor_schema()  # "converter factor" -> converter_factor
    got = {r["Material"]: r["converter_factor"] for r in out.collect()}
    assert got == {"P1": None, "P2": 2.5}


def test_conform_maps_other_column_names(spark):
    from edge import Case, roles as make_roles

    r = make_roles(spark, [Case("A"), Case("B", base=False)])
    renamed = r.candidate.withColumnRenamed("PartName", "sku").withColumnRenamed(
        "PartSite", "site")
    custom = S.CandidateCols(product="sku", location="site")
    back = Roles(renamed, r.baseline, r.factor, r.cov, r.service).conform(candidate=custom)
    assert back.candidate.columns == r.candidate.columns
    assert sorted(back.candidate.collect()) == sorted(r.candidate.collect())


def test_roles_read_refuses_missing_columns(spark, tmp_path):
    import pytest as _pytest

    from edge import Case, roles as make_roles

    r = make_roles(spark, [Case("A")])
    r = Roles(r.candidate.drop("Daily_DemandDirect"), r.baseline, r.factor, r.cov, r.service)
    r.write(str(tmp_path / "roles"))
    with _pytest.raises(ValueError, match="Daily_DemandDirect"):
        Roles.read(spark, str(tmp_path / "roles"), with_candidate2=False)


def test_validate_names_what_is_wrong(spark):
    import pytest as _pytest

    from edge import Case, roles as make_roles
    from stocklens import Analysis

    r = make_roles(spark, [Case("A")])
    bad = Roles(r.candidate.withColumn("Safety_StockUnits", r.candidate["PartName"]),
                r.baseline.drop("CFR"), r.factor, r.cov, r.service)
    with _pytest.raises(ValueError) as err:
        Analysis(bad, SNAPSHOT, SEGMENT)
    assert "candidate.Safety_StockUnits: string is not numeric" in str(err.value)
    assert "baseline.CFR: missing" in str(err.value)
    # integer measures and numeric keys are fine
    ok = Roles(r.candidate.withColumn("Safety_StockUnits", r.candidate["Safety_StockUnits"]
                                      .cast("bigint")), r.baseline, r.factor, r.cov, r.service)
    Analysis(ok, SNAPSHOT, SEGMENT)


def test_gap_texts_and_wrong_cells(spark, tmp_path):
    declared = S.factor_schema()
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    spark.createDataFrame([("P1", "#N/A"), ("P2", " N/A "), ("P3", ""), ("P4", "NaN"), ("P5", "2.5"), ("#N/A", "null"), ("null", None)],
                          "Material string, converter_factor string").write.parquet(good)
    got = sorted(((r[0], r[1]) for r in ingest.scan_role(spark, good, declared).collect()), key=str)
    assert got == sorted([("P1", None), ("P2", None), ("P3", None), ("P4", None), ("P5", 2.5), (None, None), ("null", None)], key=str)
    spark.createDataFrame([("P1", "abc")], "Material string, converter_factor string").write.parquet(bad)
    with pytest.raises(Exception, match="column converter_factor: not of type double: abc"):
        ingest.scan_role(spark, bad, declared).collect()


def test_written_files_do_not_grow_with_tasks(spark, tmp_path):
    import glob

    from conftest import SF001
    from stocklens.plans.analysis import Analysis

    r = Analysis.from_tables(spark, SF001).roles
    r = Roles(r.candidate.repartition(16), r.baseline.repartition(16), r.factor, r.cov, r.service)
    r.write(str(tmp_path / "roles"))
    days = glob.glob(str(tmp_path / "roles/baseline/*=*"))
    assert len(days) == 2 and all(0 < len(glob.glob(d + "/*.parquet")) <= 3 for d in days)
    prefix = "stocklens_files_"
    r.save_tables(prefix, buckets=4)
    for role, most in (("candidate", 4), ("cov", 4), ("baseline", 8)):
        assert len(spark.table(prefix + role).inputFiles()) <= most, role
