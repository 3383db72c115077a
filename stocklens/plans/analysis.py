"""One analysis over one set of role tables: the lazily built DataFrames.

``Analysis`` ties the operators together the way the source notebook chains
its tables and views: comparison -> populations -> flags -> classes ->
rollups. Everything is lazy; nothing runs until an action, and Catalyst sees
each requested result as one plan (filters pushed to the scans, unused
columns pruned).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.operators import compare, histogram, populations, rollups, rules, scenarios
from stocklens.schema import bind_baseline
from stocklens.sources import fixture
from stocklens.sources.roles import Roles


@dataclass
class Analysis:
    """The analysis of one candidate against one baseline snapshot.

    ``snapshot`` is the baseline's date to compare with (or a column that gives
    it when a query runs, see ``SnapshotHistory.latest_date``), ``segment`` the
    subsector that ``segment_snapshot_count`` counts.
    """

    roles: Roles
    snapshot: dt.date | Column
    segment: str
    thresholds: rules.Thresholds = field(default_factory=rules.Thresholds)
    hot_rows: int | None = None  # a (product, location) in more rows of a right side is split, see operators.skew

    def __post_init__(self):
        self.roles.validate()  # schema metadata only; fails before any job
        compare.carried_columns(self.roles)  # so do clashes of undeclared columns

    @staticmethod
    def from_tables(spark: SparkSession, sf_dir: str, stage: bool = True) -> "Analysis":
        """Roles derived from the driver tables in ``sf_dir``.

        With ``stage`` (default) the lineitem aggregate behind every role is
        written once per source folder and read back (see
        ``fixture.staged_pair``). ``stage=False`` plans the derivation from
        the raw tables inside every query -- for inspecting that plan; it
        repeats the aggregate once per role, so it is not the path to run
        at scale.
        """
        roles = fixture.staged_roles if stage else fixture.fixture_roles
        return Analysis(roles(spark, sf_dir), fixture.SNAPSHOT, fixture.SEGMENT)

    @staticmethod
    def from_history(spark: SparkSession, sf_dir: str) -> "Analysis":
        """As ``from_tables``, with a baseline for the year end of every year of shipping, compared at the latest."""
        history = fixture.staged_history(spark, sf_dir)
        roles = replace(fixture.staged_roles(spark, sf_dir), baseline=history.rows())
        return Analysis(roles, history.latest_date(), fixture.SEGMENT)

    # -- comparison and populations ------------------------------------------
    @cached_property
    def comparison(self) -> DataFrame:
        return compare.comparison(self.roles, self.snapshot, self.hot_rows)

    def with_comparison(self, cmp: DataFrame) -> "Analysis":
        """Same analysis over an already built (e.g. materialised) comparison."""
        out = Analysis(self.roles, self.snapshot, self.segment, self.thresholds, self.hot_rows)
        out.__dict__["comparison"] = cmp  # pre-fills the cached property
        return out

    @property
    def _at_hand(self) -> bool:
        """Whether the comparison was written, so that reading it again runs no join."""
        return self.__dict__.get("comparison_at_hand", False)

    def materialized(self) -> "Analysis":
        """The comparison written once to the shared folder (S7, the CTAS).

        Later populations, counts and histograms scan its parquet files (one
        or two columns each, with pushed filters) instead of re-running the
        four joins, and a lost executor only costs a re-read.
        """
        from stocklens.session import materialize

        out = self.with_comparison(materialize(self.comparison, "comparison"))
        out.__dict__["comparison_at_hand"] = True
        return out

    @property
    def final(self) -> DataFrame:
        """Population classified by the rules."""
        return populations.final_su(self.comparison)

    @property
    def flagged(self) -> DataFrame:
        return rules.flags(self.final)

    @property
    def classified(self) -> DataFrame:
        return rules.classify(self.flagged, self.thresholds)

    def summary(self) -> DataFrame:
        return rollups.summary(self.classified)

    def histogram(self, name: str) -> DataFrame:
        spec = histogram.SPECS[name]
        return histogram.spec_histogram(populations.existing(self.comparison), spec, self._values({"h": spec}))

    def histograms(self) -> DataFrame:
        """All six histograms of the analysis in two passes over F2's values."""
        return histogram.histograms(populations.existing(self.comparison), histogram.SPECS, self._values(histogram.SPECS))

    def _values(self, specs: dict[str, histogram.HistogramSpec]) -> DataFrame | None:
        """The histograms' values, written, so that the comparison's joins run once; None where there is no join to run."""
        return None if self._at_hand else histogram.written(populations.existing(self.comparison), specs)

    def segment_snapshot_count(self) -> DataFrame:
        return rollups.count_rows(
            populations.segment_snapshot(self.roles, self.snapshot, self.segment)
        )

    def min_snapshot(self) -> DataFrame:
        return rollups.min_snapshot(bind_baseline(self.roles.baseline))

    def grand_totals(self) -> DataFrame:
        """A8-A10 in one aggregate over F4."""
        return self.final.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.sum("final_su").alias("total_su"),
            F.sum("final_usd").alias("total_usd"),
        )

    # -- SQL views (S8) ----------------------------------------------------------
    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views for SQL users, one per table/view of the analysis.

        A view over a DataFrame is only a name for its plan: nothing runs
        until a query reads it, and each query is optimised as a whole
        (filters still reach the scans). The view keeps that plan when another
        view is replaced; ``plans.views`` has them as SQL text, read anew.
        """
        views = {
            "comparison": self.comparison,
            "existing_in_both": populations.existing(self.comparison),
            "final_units": populations.final_units(self.comparison),
            "final_su": self.final,
            "reco": populations.reco(self.comparison),
            "nonzero_candidate": populations.nonzero_candidate(self.comparison),
            "flagged": self.flagged,
            "classified": self.classified,
            "class_rollup": rollups.class_rollup(self.classified),
            "summary": self.summary(),
            "total_rows": self.grand_totals().select("total_rows"),
            "total_su": self.grand_totals().select("total_su"),
            "total_usd": self.grand_totals().select("total_usd"),
        }
        if self.roles.candidate2 is not None:
            views["scenario_pair"] = self.scenario_pair()
        names = []
        for name, df in views.items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    # -- scenarios -------------------------------------------------------------
    def scenario_catalog(self) -> dict[str, DataFrame]:
        out = {"first": self.roles.candidate}
        if self.roles.candidate2 is not None:
            out["second"] = self.roles.candidate2
        return out

    def scenario_pair(self) -> DataFrame:
        if self.roles.candidate2 is None:
            raise ValueError("the scenario pair needs a second candidate (roles.candidate2)")
        return scenarios.scenario_pair(self.roles.candidate, self.roles.candidate2, hot_rows=self.hot_rows)
