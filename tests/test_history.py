"""Snapshots from table dates in a partitioned history."""

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stocklens.plans.analysis import Analysis
from stocklens.sources import fixture
from stocklens.sources.history import SnapshotHistory
from stocklens.sources.roles import Roles


@pytest.fixture(scope="module")
def history(spark):
    return fixture.staged_history(spark, SF001)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_dates_are_the_tables_own(spark, history):
    years = {r.y for r in spark.read.parquet(f"{SF001}/lineitem.parquet").select(F.year("l_shipdate").alias("y")).distinct().collect()}
    assert {r.snapshot_date for r in history.dates().collect()} == {dt.date(y, 12, 31) for y in years}
    assert history.rows().count() == fixture.history(fixture.pair(spark, SF001, by_year=True)).count()


def test_the_earliest_date_reads_no_data_file(spark, history, tmp_path):
    """The plan names no column of the files, and unreadable files do not matter."""
    plan = _plan(history.earliest())
    assert "binaryFile" in plan and "ReadSchema: struct<>" in plan and "parquet" not in plan.replace("*.parquet", "").lower().split("location")[0]
    want = history.earliest().first().min_snapshot
    own = SnapshotHistory.write(history.rows(), str(tmp_path / "h"))
    for f in _files(tmp_path / "h"):
        with open(f, "wb") as out:
            out.write(b"no parquet")
    crc = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "h") for f in fs if f.endswith(".crc")]
    for f in crc:
        os.unlink(f)
    assert own.earliest().first().min_snapshot == want


def test_partitions_are_pruned_when_the_query_runs(spark, history, tmp_path):
    """The latest date is a subquery in the partition filters; files of other days are not opened."""
    own = SnapshotHistory.write(history.rows(), str(tmp_path / "h"))
    latest = own.dates().agg(F.max("snapshot_date")).first()[0]
    roles = replace(Analysis.from_tables(spark, SF001).roles, baseline=own.rows())
    at_run, fixed = Analysis(roles, own.latest_date(), "ECONOMY"), Analysis(roles, latest, "ECONOMY")
    for df in (at_run.segment_snapshot_count(), at_run.summary()):
        scan = next(x for x in _plan(df).splitlines() if "FileScan parquet" in x and "PartitionFilters: [" in x and "KEYFIGUREDATE" in x)
        assert "ubquery" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert at_run.segment_snapshot_count().first() == fixed.segment_snapshot_count().first()
    assert sorted(map(str, at_run.summary().collect())) == sorted(map(str, fixed.summary().collect()))
    for f in _files(tmp_path / "h"):  # only the latest day's files stay readable
        if str(latest) not in f:
            with open(f, "wb") as out:
                out.write(b"no parquet")
            os.unlink(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    assert at_run.segment_snapshot_count().first().n > 0


def test_roles_renew_one_day(spark, history, tmp_path):
    roles = replace(Analysis.from_tables(spark, SF001).roles, baseline=history.rows())
    path = str(tmp_path / "roles")
    roles.write(path)
    before = {f: os.stat(f).st_mtime_ns for f in _files(path)}
    day = history.earliest().first().min_snapshot
    replace(roles, baseline=history.rows().filter(F.col("KEYFIGUREDATE") == day).limit(7)).replace_snapshots(path)
    after = {f: os.stat(f).st_mtime_ns for f in _files(path)}
    assert {f: t for f, t in before.items() if str(day) not in f} == {f: t for f, t in after.items() if str(day) not in f}
    back = Roles.read(spark, path).baseline
    assert back.filter(F.col("KEYFIGUREDATE") == day).count() == 7 and back.filter(F.col("KEYFIGUREDATE") > day).count() == history.rows().filter(F.col("KEYFIGUREDATE") > day).count()


def test_timestamps_take_a_date_from_a_query(spark, history):
    """A snapshot given as a column also fits a timestamp column: any time of that day."""
    from stocklens.operators.compare import snapshot_predicate

    df = spark.sql("SELECT * FROM VALUES (timestamp'2001-12-31 10:00:00'), (timestamp'2001-12-30 23:59:59'), (timestamp'2002-01-01 00:00:00') AS t(at)")
    got = df.filter(snapshot_predicate(df, "at", history.latest_date())).collect()
    assert [r["at"].hour for r in got] == [10]


def test_a_history_is_dealt_while_its_rows_are_narrow(spark, tmp_path, monkeypatch):
    """The rows go to their year's files before the baseline's columns are made; files stay one a day where they are small."""
    plans = []
    write = SnapshotHistory.write
    monkeypatch.setattr(SnapshotHistory, "write", staticmethod(lambda df, path, **how: plans.append((df, how)) or write(df, path, **how)))
    fixture.cleanup(spark)
    staged = fixture.staged_history(spark, SF001)
    (df, how), = plans
    assert how == {"dealt": True}
    tree = _plan(df)
    assert "REBALANCE" in tree and tree.index(" AS PRDID") < tree.index("REBALANCE") and " AS PRDID" not in tree[tree.index("REBALANCE"):]
    assert len(_files(staged.path.removeprefix("file:"))) == staged.dates().count()
    plain = fixture.history(fixture.pair(spark, SF001, by_year=True))
    assert staged.rows().exceptAll(plain.select(staged.rows().columns)).isEmpty() and staged.rows().count() == plain.count()
