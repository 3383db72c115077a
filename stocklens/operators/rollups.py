"""Aggregates over populations: counts, sums, buckets, contingency, summary.

Every aggregate here is an exact built-in (``count``, ``sum``, ``min``)
planned as partial + final hash aggregation, so each executor combines its
rows before the shuffle and only one row per group and task crosses the
network -- a key holding a third of the rows costs no more than any other.
The single-row results are global aggregates; the class rollup has at most
21 groups.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions.arith import share_pct
from stocklens.functions.memo import per_application
from stocklens.operators import populations as P
from stocklens.schema import BUCKET_NAMES

N = "n"  # name of every scalar count column


def count_rows(df: DataFrame, alias: str = N) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


# --- the 24 counts over the comparison (C2-C25) ------------------------------
# key -> (population, extra predicate or None); the extra predicate is built
# lazily so that asking for one count builds one predicate.

_pop = P.predicate


def _within(col: str, limit: float = 20.0) -> Column:
    return F.col(col).between(-limit, limit)


def _c(name: str) -> Column:
    return F.col(name)


_COUNT_SPECS: dict[str, tuple[str, Callable[[], Column] | None]] = {
    "count_comparison": ("all", None),
    "count_has_final": ("all", lambda: _c("final_su").isNotNull()),
    "count_existing": ("existing", None),
    "count_within20": ("final_units", lambda: _within("final_su_diff")),
    "count_lower": ("final_units", lambda: _c("final_su_diff") < 0),
    "count_nonzero": ("nonzero", None),
    "count_nonzero_within20": ("nonzero", lambda: _within("final_su_diff")),
    "count_cycle_within20": ("final_units", lambda: _within("final_su_cycle_diff")),
    "count_nonzero_cycle_within20": ("nonzero", lambda: _within("final_su_cycle_diff")),
    "count_nonzero_cycle_higher": ("nonzero", lambda: _c("final_su_cycle_diff") > 0),
    "count_nonzero_higher": ("nonzero", lambda: _c("final_su_diff") > 0),
    "reco_cand_nz": ("reco", lambda: _c("cand_units") != 0),
    "reco_z_nz": ("reco", lambda: (_c("cand_su") == 0) & (_c("reco_su") != 0)),
    "reco_z_z": ("reco", lambda: (_c("cand_su") == 0) & (_c("reco_su") == 0)),
    "reco_nz_z": ("reco", lambda: (_c("cand_units") != 0) & (_c("reco_units") == 0)),
    "reco_nz_nz": ("reco", lambda: (_c("cand_units") != 0) & (_c("reco_units") != 0)),
    "count_final": ("final_units", None),
    "count_final_su_nz": ("final_units", lambda: _c("cand_su") != 0),
    "final_cand_nz": ("final_units", lambda: _c("cand_units") != 0),
    "final_z_nz": ("final_units", lambda: (_c("cand_units") == 0) & (_c("final_units") != 0)),
    "final_z_z": ("final_units", lambda: (_c("cand_units") == 0) & (_c("final_units") == 0)),
    "final_nz_z": ("final_units", lambda: (_c("cand_units") != 0) & (_c("final_units") == 0)),
    "final_nz_nz": ("final_units", lambda: (_c("cand_units") != 0) & (_c("final_units") != 0)),
    "count_final_su": ("final_su", None),
}
COUNT_KEYS = tuple(_COUNT_SPECS)


@per_application
def _predicate(key: str) -> Column:
    pop, extra = _COUNT_SPECS[key]
    pred = _pop(pop)
    return pred if extra is None else pred & extra()


def count(cmp: DataFrame, key: str) -> DataFrame:
    """One of the standalone counts: filter (pushed down) then ``count(*)``."""
    return count_rows(cmp.filter(_predicate(key)))


def scorecard(cmp: DataFrame) -> DataFrame:
    """All 24 comparison counts in one pass (conditional aggregation).

    ``count_if`` treats a NULL predicate as false, like ``WHERE``.
    """
    return cmp.agg(*[F.count_if(_predicate(k)).alias(k) for k in COUNT_KEYS])


def contingency(cmp: DataFrame, which: str) -> DataFrame:
    """2x2 zero/non-zero table of candidate vs baseline units (F5 or F3).

    A NULL candidate gives a NULL cell key; such rows are kept in their own
    group rather than dropped.
    """
    pop, base = {"reco": ("reco", "reco_units"), "final": ("final_units", "final_units")}[which]
    return (
        cmp.filter(_pop(pop))
        .groupBy(
            (F.col("cand_units") == 0).alias("cand_zero"),
            (F.col(base) == 0).alias("base_zero"),
        )
        .agg(F.count(F.lit(1)).alias(N))
    )


# --- sums --------------------------------------------------------------------

def min_snapshot(baseline_bound: DataFrame) -> DataFrame:
    """A1: earliest snapshot date in the baseline."""
    return baseline_bound.agg(F.min("i_snapshot").alias("min_snapshot"))


def totals_existing(cmp: DataFrame) -> DataFrame:
    """A2: eleven totals over F2."""
    return P.existing(cmp).agg(*[F.sum(c).alias(f"sum_{c}") for c in _TOTALS_EXISTING])


def _su_sums(df: DataFrame) -> DataFrame:
    return df.agg(*[F.sum(c).alias(f"sum_{c}") for c in ("cand_su", "reco_su", "final_su")])


def totals_su_nonzero(cmp: DataFrame) -> DataFrame:
    """A3: SU totals over F3 rows with a non-zero candidate."""
    return _su_sums(P.final_units(cmp).filter(F.col("cand_su") != 0))


def totals_units(cmp: DataFrame) -> DataFrame:
    """Unit totals over F3."""
    return P.final_units(cmp).agg(
        *[F.sum(c).alias(f"sum_{c}") for c in ("cand_units", "reco_units", "final_units")]
    )


def bucket_profile(df: DataFrame) -> DataFrame:
    """Stock total, headline buckets, then every bucket, as sums.

    ``situational_safety_and_cycle_su`` is a sum of two sums: NULL when either
    bucket is NULL on every row (kept, not coalesced).
    """
    s = F.sum
    return df.agg(
        s("stock_total").alias("total_stock_su"),
        s("bucket_situational_safety").alias("situational_safety_su"),
        s("bucket_situational_cycle").alias("situational_cycle_su"),
        (s("bucket_situational_safety") + s("bucket_situational_cycle")).alias(
            "situational_safety_and_cycle_su"
        ),
        s("bucket_param_cycle").alias("param_cycle_su"),
        s("bucket_productive_safety").alias("productive_safety_su"),
        *[s(b).alias(f"sum_{b}") for b in BUCKET_NAMES],
    )


def buckets_nonzero(cmp: DataFrame) -> DataFrame:
    return bucket_profile(P.final_units(cmp).filter(F.col("cand_su") != 0))


def buckets_all(cmp: DataFrame) -> DataFrame:
    return bucket_profile(P.final_units(cmp))


def bucket_reconcile(cmp: DataFrame) -> DataFrame:
    """A5: sum of the bucket sums next to the stock total (reported, not asserted)."""
    total = None
    for b in BUCKET_NAMES:
        total = F.sum(b) if total is None else total + F.sum(b)
    return P.final_units(cmp).agg(
        total.alias("sum_all_buckets"), F.sum("stock_total").alias("total_stock")
    )


# --- all sums in one pass -------------------------------------------------------

_TOTALS_EXISTING = ("cand_units", "reco_units", "final_units", "cand_su", "reco_su", "final_su",
                    "cand_days", "reco_days", "final_days", "cand_on_hand_cost", "final_usd")


def sums_card(cmp: DataFrame) -> DataFrame:
    """A2-A7 in one pass: every total and bucket profile as conditional sums.

    ``SUM(CASE WHEN pop THEN x END)`` equals ``SUM(x)`` over the filtered
    rows, NULL included (no rows, or only NULLs, give NULL), so the six
    separate aggregates become one scan of the comparison. Column names are
    ``<query>__<column>`` of the separate queries.
    """
    c = F.col
    existing = _pop("existing")
    final = _pop("final_units")
    final_nz = final & (c("cand_su") != 0)

    def s(pred: Column, col: str) -> Column:
        return F.sum(F.when(pred, c(col)))

    def profile(pred: Column, prefix: str) -> list[Column]:
        return [
            s(pred, "stock_total").alias(f"{prefix}__total_stock_su"),
            s(pred, "bucket_situational_safety").alias(f"{prefix}__situational_safety_su"),
            s(pred, "bucket_situational_cycle").alias(f"{prefix}__situational_cycle_su"),
            (s(pred, "bucket_situational_safety") + s(pred, "bucket_situational_cycle")).alias(
                f"{prefix}__situational_safety_and_cycle_su"),
            s(pred, "bucket_param_cycle").alias(f"{prefix}__param_cycle_su"),
            s(pred, "bucket_productive_safety").alias(f"{prefix}__productive_safety_su"),
            *[s(pred, b).alias(f"{prefix}__sum_{b}") for b in BUCKET_NAMES],
        ]

    all_buckets = None
    for b in BUCKET_NAMES:
        all_buckets = s(final, b) if all_buckets is None else all_buckets + s(final, b)
    return cmp.agg(
        *[s(existing, x).alias(f"totals_existing__sum_{x}") for x in _TOTALS_EXISTING],
        *[s(final_nz, x).alias(f"totals_su_nonzero__sum_{x}")
          for x in ("cand_su", "reco_su", "final_su")],
        *[s(final, x).alias(f"totals_units__sum_{x}")
          for x in ("cand_units", "reco_units", "final_units")],
        *profile(final_nz, "buckets_nonzero"),
        *profile(final, "buckets_all"),
        all_buckets.alias("bucket_reconcile__sum_all_buckets"),
        s(final, "stock_total").alias("bucket_reconcile__total_stock"),
    )


# --- classification rollup and summary ---------------------------------------

def class_rollup(classified: DataFrame) -> DataFrame:
    """Rows, final SU and final USD per label."""
    return classified.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("final_su").alias("final_su_sum"),
        F.sum("final_usd").alias("final_usd_sum"),
    )


def summary(classified: DataFrame) -> DataFrame:
    """Share of rows, SU and USD per label, largest SU share first.

    The grand totals are the totals of the (at most 21) label rows: a row
    count is the sum of the per-label counts, and a SUM over all rows is the
    sum of the per-label SUMs with the same NULL behaviour (NULL only when
    every value is NULL). So the data is read once; the totals are a window
    over the tiny rollup, never over the rows themselves.
    """
    everything = Window.partitionBy()
    rolled = class_rollup(classified)
    totals = rolled.select(
        "*",
        F.sum("n_rows").over(everything).alias("total_rows"),
        F.sum("final_su_sum").over(everything).alias("total_su"),
        F.sum("final_usd_sum").over(everything).alias("total_usd"),
    )
    return totals.select(
        "label",
        "n_rows",
        "final_su_sum",
        "total_rows",
        "total_su",
        "total_usd",
        share_pct("n_rows", "total_rows").alias("pct_rows"),
        share_pct("final_su_sum", "total_su").alias("pct_su"),
        share_pct("final_usd_sum", "total_usd").alias("pct_usd"),
    ).orderBy(F.desc_nulls_last("pct_su"))
