"""Row flags (P8-P11) and the ordered classification rule list.

The rules are data: one ordered list of ``(code, predicate)``. It is folded
into a single ``CASE WHEN`` (``F.when(...).when(...).otherwise(...)``), so the
first matching rule wins and the whole ladder is one code-generated
expression evaluated per row inside the scan stage -- no UDF, no shuffle.

The label and the code are two folds of the *same* list that differ only in
how "a transition type is present" is tested (trap T10): the label ladder
uses ``IS NOT NULL``; the code ladder uses ``<> 'null'`` (so the literal
string ``'null'`` counts as present for the label but not for the code).
Several codes share one label (9 and 13; code 20 comes from three rules).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.arith import safe_div
from stocklens.functions.memo import per_application
from stocklens.schema import NO, NO_CFR_INFO, NULL_STRING, YES, quoted


@dataclass(frozen=True)
class Thresholds:
    """Rule thresholds (fixed values of the source analysis as defaults)."""

    short_days: float = 3.0
    long_days: float = 7.0
    low_cov: float = 0.5
    low_cycle_ratio: float = 0.2
    high_cycle_ratio: float = 0.4
    diff_pct: float = 20.0


# Label per code, in our own words. Code 13 reads like 9 ("in line"), and
# code 20 covers the three "no service information" rules.
LABELS: dict[int, str] = {
    1: "Both recommend zero safety stock",
    2: "Candidate zero, baseline short cover with transition stock: low risk",
    3: "Candidate zero, baseline short cover without transition: medium risk, product mix",
    4: "Candidate zero, baseline medium cover with transition stock: medium or high risk",
    5: "Candidate zero, baseline medium cover: medium risk, candidate CoV low or missing",
    6: "Candidate zero, baseline medium cover: medium risk, no safety stock unexplained",
    7: "Candidate zero, baseline long cover: high risk, candidate CoV low or missing",
    8: "Candidate zero, baseline long cover: high risk, no safety stock unexplained",
    9: "Candidate in line with expectation",
    10: "Candidate higher but not explained by CoV: verify",
    11: "Candidate higher, explained by a CoV difference",
    12: "Candidate too high for the achieved service",
    13: "Candidate in line with expectation",
    14: "Safety stock policy not followed by baseline: candidate may be right",
    15: "Candidate lower, explained by a CoV difference",
    16: "Baseline possibly too high: candidate may meet the need",
    17: "Inconclusive: possible supply planning issue",
    18: "Potentially high risk: candidate possibly too low",
    19: "High risk: candidate too low",
    20: "No service level information",
    21: "Not assigned",
}
UNASSIGNED = 21


def flags(df: DataFrame) -> DataFrame:
    """P8-P11 plus the aliases the rules read, on ``final_su`` rows."""
    final_su = F.col("final_su")
    cfr, target = F.col("cfr"), F.col("service_level")
    return df.select(
        "*",
        F.when(
            final_su != 0,
            safe_div(F.col("bucket_situational_cycle") + F.col("bucket_situational_safety"), final_su),
        )
        .otherwise(F.lit(0.0))
        .alias("cycle_to_final_ratio"),
        F.when(F.col("cand_su") > final_su, F.lit(YES)).otherwise(F.lit(NO)).alias("cand_higher"),
        F.when(cfr.isNotNull() & (cfr > target), F.lit(YES))
        .when(cfr.isNotNull() & (cfr <= target), F.lit(NO))
        .otherwise(F.lit(NO_CFR_INFO))
        .alias("cfr_on_target"),
        F.when(F.col("cand_weekly_cov") >= F.col("base_cov"), F.lit(YES))
        .otherwise(F.lit(NO))
        .alias("cand_cov_higher"),
    )


def rule_list(present: Callable[[Column], Column], t: Thresholds = Thresholds()) -> list[tuple[int, Column]]:
    """Ordered ``(code, predicate)``; ``present(tr)`` tests a transition type."""
    w, b, d = F.col("cand_su"), F.col("final_su"), F.col("final_days")
    tr, cov = F.col("transition_type"), F.col("cand_weekly_cov")
    r, diff = F.col("cycle_to_final_ratio"), F.col("final_su_diff")
    hi_yes, hi_no = F.col("cand_higher") == YES, F.col("cand_higher") == NO
    cov_yes, cov_no = F.col("cand_cov_higher") == YES, F.col("cand_cov_higher") == NO
    cfr = F.col("cfr_on_target")

    zero_vs_stock = (w == 0) & (b != 0)
    short = d <= t.short_days
    medium = (d > t.short_days) & (d <= t.long_days)
    long_ = d > t.long_days
    cov_low = (cov <= t.low_cov) | cov.isNull()
    cov_high = cov > t.low_cov
    r_low = r <= t.low_cycle_ratio
    r_mid = (r > t.low_cycle_ratio) & (r <= t.high_cycle_ratio)
    r_high = r > t.high_cycle_ratio
    r_not_high = r <= t.high_cycle_ratio
    higher = (w != 0) & hi_yes
    lower_cov = (w != 0) & hi_no & cov_yes

    return [
        (1, (w == 0) & (b == 0)),
        (2, zero_vs_stock & short & present(tr)),
        (3, zero_vs_stock & short & tr.isNull()),
        (4, zero_vs_stock & medium & present(tr)),
        (5, zero_vs_stock & medium & tr.isNull() & cov_low),
        (6, zero_vs_stock & medium & tr.isNull() & cov_high),
        (7, zero_vs_stock & long_ & cov_low),
        (8, zero_vs_stock & long_ & cov_high),
        (9, higher & r_low & (diff <= t.diff_pct)),
        (10, higher & r_low & (diff > t.diff_pct) & cov_no),
        (11, higher & r_low & (diff > t.diff_pct) & cov_yes),
        (12, higher & r_mid & (cfr == YES)),
        (13, higher & r_mid & (cfr == NO)),
        (20, higher & r_mid & (cfr == NO_CFR_INFO)),
        (14, higher & r_high),
        (15, (w != 0) & hi_no & cov_no),
        (16, lower_cov & r_high & (cfr == YES)),
        (17, lower_cov & r_high & (cfr == NO)),
        (20, lower_cov & r_high & (cfr == NO_CFR_INFO)),
        (18, lower_cov & r_not_high & (cfr == YES)),
        (19, lower_cov & r_not_high & (cfr == NO)),
        (20, lower_cov & r_not_high & (cfr == NO_CFR_INFO)),
    ]


def fold(rules: list[tuple[int, Column]], default: int = UNASSIGNED) -> Column:
    """First matching rule wins; a NULL predicate does not match."""
    expr = None
    for code, pred in rules:
        expr = F.when(pred, F.lit(code)) if expr is None else expr.when(pred, F.lit(code))
    return expr.otherwise(F.lit(default))


def label_of(code: Column) -> Column:
    """Label of a code: one lookup in a literal map (``code`` is read once)."""
    pairs = []
    for c, text in LABELS.items():
        pairs += [F.lit(c), F.lit(text)]
    return F.element_at(F.create_map(*pairs), code)


def label_present(tr: Column) -> Column:
    return tr.isNotNull()


def code_present(tr: Column) -> Column:
    return tr != F.lit(NULL_STRING)


@per_application
def ladders(t: Thresholds) -> tuple[Column, Column]:
    """(label ladder, code ladder) as code-valued expressions."""
    return fold(rule_list(label_present, t)), fold(rule_list(code_present, t))


def classify(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add ``label`` (P13) and ``code`` (P14) to flagged rows.

    The label ladder yields a code first and is mapped to text in a second
    projection, so each ladder appears once in the generated code.
    """
    cols = [quoted(c) for c in df.columns]
    label_ladder, code_ladder = ladders(t)
    coded = df.select("*", label_ladder.alias("_label_code"), code_ladder.alias("code"))
    return coded.select(*cols, label_of(F.col("_label_code")).alias("label"), "code")
