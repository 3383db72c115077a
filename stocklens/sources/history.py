"""A baseline of many snapshots, kept as one table partitioned by its date.

The dates come from the listing of the partitions, so asking for the earliest
or the latest opens no data file. A comparison with the latest snapshot takes
its date from that listing as a scalar subquery: Spark runs it first and then
lists and reads that day's partition alone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens import schema as S
from stocklens.sources import ingest


@dataclass(frozen=True)
class SnapshotHistory:
    """The baseline history in the folder ``path``, partitioned by ``column``."""

    spark: SparkSession
    path: str
    column: str = S.BaselineCols().snapshot

    @staticmethod
    def write(baseline: DataFrame, path: str, column: str = S.BaselineCols().snapshot, dealt: bool = False) -> "SnapshotHistory":
        """Write a new history; files are sized by bytes. ``dealt``: the rows come rebalanced by date already."""
        rows = baseline if dealt else baseline.hint("rebalance", F.col(S.quoted(column)))
        writer = rows.write.mode("overwrite")
        writer.partitionBy(column).parquet(path)
        return SnapshotHistory(baseline.sparkSession, path, column)

    def replace(self, baseline: DataFrame, only: list[dt.date] | None = None) -> None:
        """Put the snapshots that ``baseline`` holds in place of those of the same dates; no other file is touched."""
        ingest.replace_snapshots(baseline, self.path, self.column, only=only)

    def rows(self) -> DataFrame:
        """All snapshots, in the columns' declared order with undeclared ones behind."""
        df = self.spark.read.parquet(self.path)
        declared = [c for c in S.baseline_schema().fieldNames() if c in df.columns]
        others = [c for c in df.columns if c not in declared]
        return df.select(*[S.quoted(c) for c in [*declared, *others]])

    def dates(self) -> DataFrame:
        """``snapshot_date``: one row per snapshot, from the listing of files; none of them is opened."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.path)
        return files.select(F.col(S.quoted(self.column)).cast("date").alias("snapshot_date")).filter("snapshot_date IS NOT NULL").distinct()

    def earliest(self) -> DataFrame:
        """A1: the earliest snapshot date."""
        return self.dates().agg(F.min("snapshot_date").alias("min_snapshot"))

    def latest_date(self) -> Column:
        """The latest snapshot date, looked up when a query runs: as the ``snapshot`` of an ``Analysis`` it prunes partitions."""
        return self.dates().agg(F.max("snapshot_date")).scalar()
