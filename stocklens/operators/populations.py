"""Named row populations over the comparison table.

Each is a plain ``filter`` on the lazy comparison, so Catalyst pushes it
through the projection; an ``IS NOT NULL`` on a baseline measure also turns
the LEFT joins that feed it into inner joins.

Two populations are both called "final" in the source analysis and differ:
``final_units`` (v1) needs a usable conversion factor, ``final_su`` (v2) does
not. They are kept apart by name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.operators.compare import snapshot_predicate
from stocklens.schema import bind_baseline
from stocklens.sources.roles import Roles


def predicate(name: str) -> Column:
    """Row predicate of a named population over the comparison's columns.

    ``all`` (every row), ``existing`` (F2), ``final_units`` (F3),
    ``final_su`` (F4), ``reco`` (F5), ``nonzero`` (F6).
    """
    c = F.col
    return {
        "all": F.lit(True),
        "existing": c("final_su").isNotNull(),
        "final_units": c("final_units").isNotNull(),
        "final_su": c("final_su").isNotNull(),
        "reco": c("reco_units").isNotNull(),
        "nonzero": c("reco_units").isNotNull() & (c("cand_su") != 0),
    }[name]


def existing(cmp: DataFrame) -> DataFrame:
    """rows with a final baseline value in normalised units."""
    return cmp.filter(predicate("existing"))


def final_units(cmp: DataFrame) -> DataFrame:
    """F3 (first "final"): rows with a final baseline value in units."""
    return cmp.filter(predicate("final_units"))


def final_su(cmp: DataFrame) -> DataFrame:
    """F4 (second "final"): same predicate as F2."""
    return cmp.filter(predicate("final_su"))


def reco(cmp: DataFrame) -> DataFrame:
    """rows with a recommended baseline value in units."""
    return cmp.filter(predicate("reco"))


def nonzero_candidate(cmp: DataFrame) -> DataFrame:
    """recommended baseline in units known and candidate SU non-zero.

    The predicate reads the *recommended* value although its users compare
    against the *final* difference; kept as the analysis defines it.
    """
    return cmp.filter(predicate("nonzero"))


def segment_snapshot(roles: Roles, snapshot: dt.date | Column, segment: str) -> DataFrame:
    """baseline rows of one snapshot and subsector with a final value."""
    i = bind_baseline(roles.baseline)
    return i.filter(
        snapshot_predicate(i, "i_snapshot", snapshot)
        & (F.col("i_subsector") == F.lit(segment))
        & F.col("i_final_su").isNotNull()
    )
