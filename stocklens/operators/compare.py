"""The comparison table: candidate joined to one baseline snapshot.

All joins are LEFT joins, as in the source analysis: every candidate row is
kept, and duplicate keys on a right side fan out (no de-duplication).

Physical shape. The three joins on (product, location) -- baseline, CoV,
service level -- share one hash partitioning, so the candidate is shuffled
once and the three sort-merge joins run in the same stage. The factor join is
keyed on product only; it is applied to the baseline snapshot before that
(see ``baseline_with_factor``), so its different key costs one shuffle of
baseline rows instead of a re-shuffle of the wide joined rows. AQE turns it
into a broadcast join when the factor table is measured under
``spark.sql.autoBroadcastJoinThreshold``; otherwise it stays a sort-merge join
and a hot product is split by AQE's skew-join handling, which applies to the
preserved (baseline) side of a left join. No side is broadcast by hint: none
of these tables has a size bound.

The snapshot predicate is applied to the baseline *before* the join so that
it is pushed into the baseline scan and every candidate row is still kept.

Columns of the candidate and the baseline that the roles do not declare travel
along under their own names, behind the measures (P1). Names must be distinct
over both sides and the library's own columns; a clash raises before any job
and names both. What a result does not use is pruned at the scan, so carrying
them costs nothing until they are asked for.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens import schema as S
from stocklens.functions.arith import pct_diff, safe_div, su_to_unit, unit_to_su
from stocklens.functions.memo import per_application
from stocklens.operators.skew import left_join
from stocklens.sources.roles import Roles

# Output columns of ``comparison`` in order: (name, source expression).
_PASS_THROUGH = [
    ("product", "k_product"),
    ("location", "k_location"),
    ("base_product", "i_product"),
    ("base_location", "i_location"),
    ("snapshot_date", "i_snapshot"),
    ("subsector", "i_subsector"),
    ("transition_type", "i_transition_type"),
    ("factor", "c_factor"),
    ("cand_weekly_cov", "k_weekly_cov"),
    ("cand_lt_cov", "k_lt_cov"),
    ("cand_target_service", "k_target_service"),
    ("cand_avg_on_hand", "k_avg_on_hand"),
    ("cand_direct_demand", "k_direct_demand"),
    ("cand_on_hand_cost", "k_on_hand_cost"),
    ("base_cov", "cv_cov"),
    ("service_level", "sl_service_level"),
    ("cfr", "i_cfr"),
    ("final_usd", "i_final_usd"),
    ("stock_total", "i_stock_total"),
] + [(b, b) for b in S.BUCKET_NAMES]

MEASURES = [
    "cand_days",
    "reco_days",
    "reco_days_diff",
    "final_days",
    "final_days_diff",
    "cand_units",
    "cand_su",
    "reco_units",
    "reco_su",
    "reco_units_diff",
    "reco_su_diff",
    "final_units",
    "final_su",
    "final_units_diff",
    "final_su_diff",
    "cycle_ratio",
    "cand_su_cycle",
    "final_su_cycle_diff",
]

COLUMNS = [name for name, _ in _PASS_THROUGH] + MEASURES

# Columns that flags and classes add behind the comparison's.
ADDED_LATER = ["cycle_to_final_ratio", "cand_higher", "cfr_on_target", "cand_cov_higher", "label", "code", "_label_code"]


class ColumnClash(ValueError):
    """Two columns of the comparison would have one name."""


@per_application
def measures() -> list[Column]:
    """Derived measures P2-P7 over the bound, joined columns."""
    cand_days = F.col("k_ss_days")
    reco_days = F.col("i_reco_days")
    final_days = F.col("i_final_days")
    cand_units = F.col("k_ss_units")
    factor = F.col("c_factor")
    cand_su = unit_to_su(cand_units, factor)
    reco_su = F.col("i_reco_su")
    final_su = F.col("i_final_su")
    reco_units = su_to_unit(reco_su, factor)
    final_units = su_to_unit(final_su, factor)
    cycle_ratio = safe_div(
        F.col("bucket_situational_safety") + F.col("bucket_situational_cycle"),
        F.col("i_stock_total"),
    )
    cand_su_cycle = (cycle_ratio + 1) * cand_su
    return [
        cand_days.alias("cand_days"),
        reco_days.alias("reco_days"),
        pct_diff(cand_days, reco_days).alias("reco_days_diff"),
        final_days.alias("final_days"),
        pct_diff(cand_days, final_days).alias("final_days_diff"),
        cand_units.alias("cand_units"),
        cand_su.alias("cand_su"),
        reco_units.alias("reco_units"),
        reco_su.alias("reco_su"),
        pct_diff(cand_units, reco_units).alias("reco_units_diff"),
        pct_diff(cand_su, reco_su).alias("reco_su_diff"),
        final_units.alias("final_units"),
        final_su.alias("final_su"),
        pct_diff(cand_units, final_units).alias("final_units_diff"),
        pct_diff(cand_su, final_su).alias("final_su_diff"),
        cycle_ratio.alias("cycle_ratio"),
        cand_su_cycle.alias("cand_su_cycle"),
        pct_diff(cand_su_cycle, final_su).alias("final_su_cycle_diff"),
    ]


@per_application
def _projection() -> list[Column]:
    return [F.col(src).alias(name) for name, src in _PASS_THROUGH] + measures()


def carried_columns(roles: Roles) -> list[tuple[str, str]]:
    """(bound name, own name) of the undeclared columns of both sides (P1); raises ``ColumnClash``."""
    sides = (
        ("candidate", "k_", S.undeclared(roles.candidate, S.CandidateCols())),
        ("baseline", "i_", S.undeclared(roles.baseline, S.BaselineCols())),
    )
    taken = {c.lower(): f"the comparison's {c}" for c in [*COLUMNS, *ADDED_LATER]}
    out, clashes = [], []
    for role, prefix, names in sides:
        for name in names:
            here = f"{role}.{name}"
            if name.lower() in taken:
                clashes.append(f"{taken[name.lower()]} and {here}")
            taken.setdefault(name.lower(), here)
            out.append((f"{S.CARRIED}{prefix}{name}", name))
    if clashes:
        raise ColumnClash("columns of one name, rename or drop one of each: " + "; ".join(clashes))
    return out


def _project(joined: DataFrame, roles: Roles) -> DataFrame:
    carried = [F.col(S.quoted(bound)).alias(name) for bound, name in carried_columns(roles)]
    return joined.select(*_projection(), *carried)


def snapshot_predicate(df: DataFrame, column: str, snapshot: dt.date | Column) -> Column:
    """Rows of ``column`` on the calendar day ``snapshot``.

    For a DATE column this is an equality; for a timestamp it is the half-open
    day ``[snapshot, snapshot + 1 day)``, so any time of day matches. Both are
    plain range predicates that reach the parquet scan. ``snapshot`` may also
    be a column, such as the scalar subquery of ``SnapshotHistory.latest_date``.
    """
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, T.DateType):
        return c == F.lit(snapshot)
    if isinstance(snapshot, Column):
        return (c >= snapshot.cast("date").cast(dtype)) & (c < F.date_add(snapshot.cast("date"), 1).cast(dtype))
    # Day bounds as text cast to the column's own type: midnight in the
    # session time zone for TIMESTAMP, wall-clock midnight for TIMESTAMP_NTZ.
    start = F.lit(f"{snapshot.isoformat()} 00:00:00").cast(dtype)
    end = F.lit(f"{(snapshot + dt.timedelta(days=1)).isoformat()} 00:00:00").cast(dtype)
    return (c >= start) & (c < end)


def _bound(roles: Roles):
    k = S.bind_candidate(roles.candidate, carry=True)
    i = S.bind_baseline(roles.baseline, carry=True)
    c = S.bind_factor(roles.factor)
    cv = S.bind_cov(roles.cov)
    sl = S.bind_service(roles.service)
    return k, i, c, cv, sl


def _same_site(left: str, right: str) -> Column:
    return (F.col(f"{left}_product") == F.col(f"{right}_product")) & (
        F.col(f"{left}_location") == F.col(f"{right}_location")
    )


def baseline_with_factor(i: DataFrame, c: DataFrame) -> DataFrame:
    """J2 applied to the baseline side: snapshot rows LEFT JOIN factor.

    ``k LEFT JOIN i LEFT JOIN c ON i.product = c.product`` equals
    ``k LEFT JOIN (i LEFT JOIN c ON i.product = c.product)``: the factor
    predicate only reads baseline columns and is never true for a missing
    baseline row, so unmatched candidates get NULL factor columns either way,
    and duplicate factor rows fan out the same matches. Joining the factor
    here means the only re-shuffle caused by its different key (product)
    moves narrow baseline rows, never the wide joined comparison rows.
    """
    return i.join(c, F.col("i_product") == F.col("c_product"), "left")


def _at_site(left: str, right: str) -> list[tuple[str, str]]:
    return [(f"{left}_product", f"{right}_product"), (f"{left}_location", f"{right}_location")]


def joined(roles: Roles, snapshot: dt.date | Column, hot_rows: int | None = None) -> DataFrame:
    """J1-J4 on bound columns, before the measures are derived."""
    k, i, c, cv, sl = _bound(roles)
    i = baseline_with_factor(i.filter(snapshot_predicate(i, "i_snapshot", snapshot)), c)
    for side, right in (("i", i), ("cv", cv), ("sl", sl)):
        k = left_join(k, right, _at_site("k", side), rows=hot_rows)
    return k


def comparison(roles: Roles, snapshot: dt.date | Column, hot_rows: int | None = None) -> DataFrame:
    """The comparison table (S7): one row per candidate row (times fan-out).

    ``hot_rows``: a (product, location) that a right side holds in more rows is
    split over several tasks (``operators.skew``); it takes a count of each
    right side's keys first.
    """
    return _project(joined(roles, snapshot, hot_rows), roles)


def _date_key(d: Column) -> Column:
    """``<day><Month name><year>``, e.g. ``31December2001`` (day not padded)."""
    return F.concat(
        F.dayofmonth(d).cast("string"), F.date_format(d, "MMMM"), F.year(d).cast("string")
    )


# Separator between product and location in the concatenated key, so that
# ('1', '23') and ('12', '3') stay distinct.
KEY_SEPARATOR = "|"


def comparison_concat_key(roles: Roles, snapshot: dt.date | Column) -> DataFrame:
    """The baseline join written on one concatenated string key.

    ``product | location _ <day><Month><year>`` on both sides. The key already
    pins the calendar day, so the same day predicate is also stated on the
    baseline: it does not change the result and lets the scan skip other
    snapshots instead of shuffling every snapshot into the join.

    Kept for parity with analyses written this way; ``comparison`` is the
    one to run. A string key is its own partitioning, so the CoV and service
    joins, which share the candidate's, come first: what is shuffled again for
    the string key is the candidate with two measures, and the wide rows that
    the baseline makes are shuffled no more.
    """
    k, i, c, cv, sl = _bound(roles)
    i = i.filter(snapshot_predicate(i, "i_snapshot", snapshot))
    k_key = F.concat(
        F.col("k_product"), F.lit(KEY_SEPARATOR), F.col("k_location"), F.lit("_"),
        _date_key(F.lit(snapshot)),
    )
    i_key = F.concat(
        F.col("i_product"), F.lit(KEY_SEPARATOR), F.col("i_location"), F.lit("_"),
        _date_key(F.col("i_snapshot")),
    )
    k = k.withColumn("_key", k_key)
    i = baseline_with_factor(i.withColumn("_ikey", i_key), c)
    j = (
        k.join(cv, _same_site("k", "cv"), "left")
        .join(sl, _same_site("k", "sl"), "left")
        .join(i, F.col("_key") == F.col("_ikey"), "left")
    )
    return _project(j, roles)


def unmatched(roles: Roles, snapshot: dt.date | Column) -> DataFrame:
    """comparison rows whose candidate has no baseline row at the snapshot.

    Written as an anti join: a matched baseline row always has non-NULL keys
    (an equality never holds on NULL), so "baseline product and location are
    NULL after the left join" is exactly "no match". Only the baseline keys
    are shuffled for the anti join, and the factor join -- keyed on the
    baseline product, which is NULL here -- is skipped; its columns are NULL.
    """
    k, i, c, cv, sl = _bound(roles)
    i_keys = i.filter(snapshot_predicate(i, "i_snapshot", snapshot)).select(
        "i_product", "i_location"
    )
    lone = k.join(
        i_keys,
        (F.col("k_product") == F.col("i_product")) & (F.col("k_location") == F.col("i_location")),
        "left_anti",
    )
    lone = lone.join(cv, _same_site("k", "cv"), "left").join(sl, _same_site("k", "sl"), "left")
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in i.schema.fields + c.schema.fields]
    return _project(lone.select("*", *nulls), roles)


def describe(df: DataFrame) -> DataFrame:
    """(col_name, data_type) of a DataFrame, from its schema only."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "col_name string, data_type string")
