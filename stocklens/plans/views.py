"""The analysis as SQL text: views over views, down to the class summary.

Every view is a ``CREATE OR REPLACE VIEW`` whose text reads other views by
name. Spark looks the names up whenever a query reads the view, so replacing
one view, or the comparison itself, changes every result above it. (A
DataFrame registered as a view, as ``Analysis.register_views`` does, keeps the
plan that it had.) Each query is still planned as a whole: the views are
expanded into one plan, so filters and columns reach the scan.

The rules are a tree here: first what the candidate recommends, then the
band in which the row lies. ``operators.rules`` has them as an ordered list;
``tests/test_views.py`` compares the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stocklens.operators import scenarios
from stocklens.operators.rules import LABELS, UNASSIGNED, Thresholds
from stocklens.schema import NO, NO_CFR_INFO, NULL_STRING, YES, CandidateCols

#: Views over the comparison, in the order in which they are made.
POPULATIONS = {
    "existing_in_both": "final_su IS NOT NULL",
    "final_units": "final_units IS NOT NULL",
    "final_su": "final_su IS NOT NULL",
    "reco": "reco_units IS NOT NULL",
    "nonzero_candidate": "reco_units IS NOT NULL AND cand_su <> 0",
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_service(on_target: int, below: int, unknown: int) -> str:
    return f"CASE cfr_on_target WHEN {_text(YES)} THEN {on_target} WHEN {_text(NO)} THEN {below} WHEN {_text(NO_CFR_INFO)} THEN {unknown} ELSE {UNASSIGNED} END"


def _code(stock_moves: str) -> str:
    """The class of a banded row; ``stock_moves`` is the test for a transition type."""

    def with_stock(yes: int, none: str) -> str:
        return f"CASE WHEN {stock_moves} THEN {yes} WHEN transition_type IS NULL THEN {none} ELSE {UNASSIGNED} END"

    nothing = (
        f"CASE cover WHEN 'short' THEN {with_stock(2, '3')}"
        f" WHEN 'medium' THEN {with_stock(4, 'IF(steady, 5, 6)')}"
        f" WHEN 'long' THEN IF(steady, 7, 8) ELSE {UNASSIGNED} END"
    )
    small_cycle = f"CASE WHEN far_above IS NULL THEN {UNASSIGNED} WHEN NOT far_above THEN 9 WHEN cand_cov_higher = {_text(YES)} THEN 11 ELSE 10 END"
    above = f"CASE cycle WHEN 'small' THEN {small_cycle} WHEN 'middle' THEN {_by_service(12, 13, 20)} WHEN 'large' THEN 14 ELSE {UNASSIGNED} END"
    below = (
        f"CASE WHEN cand_cov_higher = {_text(NO)} THEN 15 WHEN cycle = 'large' THEN {_by_service(16, 17, 20)}"
        f" WHEN cycle IS NOT NULL THEN {_by_service(18, 19, 20)} ELSE {UNASSIGNED} END"
    )
    return (
        f"CASE WHEN cand_su = 0 THEN CASE WHEN final_su = 0 THEN 1 WHEN final_su <> 0 THEN {nothing} ELSE {UNASSIGNED} END"
        f" WHEN cand_su <> 0 THEN IF(cand_higher = {_text(YES)}, {above}, {below}) ELSE {UNASSIGNED} END"
    )


def view_texts(t: Thresholds = Thresholds()) -> dict[str, str]:
    """View name -> its query, with ``{p}`` before the names of other views."""
    out = {name: f"SELECT * FROM {{p}}comparison WHERE {where}" for name, where in POPULATIONS.items()}
    out["flagged"] = f"""
        SELECT *,
          IF(final_su <> 0, try_divide(bucket_situational_cycle + bucket_situational_safety, final_su), 0D) AS cycle_to_final_ratio,
          IF(cand_su > final_su, {_text(YES)}, {_text(NO)}) AS cand_higher,
          CASE cfr > service_level WHEN true THEN {_text(YES)} WHEN false THEN {_text(NO)} ELSE {_text(NO_CFR_INFO)} END AS cfr_on_target,
          IF(cand_weekly_cov >= base_cov, {_text(YES)}, {_text(NO)}) AS cand_cov_higher
        FROM {{p}}final_su"""
    out["banded"] = f"""
        SELECT *,
          CASE WHEN final_days <= {t.short_days}D THEN 'short' WHEN final_days <= {t.long_days}D THEN 'medium' WHEN final_days > {t.long_days}D THEN 'long' END AS cover,
          coalesce(cand_weekly_cov <= {t.low_cov}D, true) AS steady,
          CASE WHEN cycle_to_final_ratio <= {t.low_cycle_ratio}D THEN 'small' WHEN cycle_to_final_ratio <= {t.high_cycle_ratio}D THEN 'middle'
               WHEN cycle_to_final_ratio > {t.high_cycle_ratio}D THEN 'large' END AS cycle,
          final_su_diff > {t.diff_pct}D AS far_above
        FROM {{p}}flagged"""
    labels = ", ".join(f"{code}, {_text(text)}" for code, text in LABELS.items())
    out["classified"] = f"""
        SELECT * EXCEPT (cover, steady, cycle, far_above, label_code), element_at(map({labels}), label_code) AS label
        FROM (SELECT *, {_code('transition_type IS NOT NULL')} AS label_code, {_code(f'transition_type <> {_text(NULL_STRING)}')} AS code FROM {{p}}banded)"""
    out["total_rows"] = "SELECT count(*) AS total_rows FROM {p}final_su"
    out["total_su"] = "SELECT sum(final_su) AS total_su FROM {p}final_su"
    out["total_usd"] = "SELECT sum(final_usd) AS total_usd FROM {p}final_su"
    out["class_rollup"] = """
        SELECT label, count(*) AS n_rows, sum(final_su) AS final_su_sum, sum(final_usd) AS final_usd_sum
        FROM {p}classified GROUP BY label"""
    out["summary"] = """
        SELECT label, n_rows, final_su_sum, total_rows, total_su, total_usd,
               try_divide(CAST(n_rows AS DOUBLE), CAST(total_rows AS DOUBLE)) * 100 AS pct_rows,
               try_divide(final_su_sum, total_su) * 100 AS pct_su,
               try_divide(final_usd_sum, total_usd) * 100 AS pct_usd
        FROM (SELECT *, sum(n_rows) OVER () AS total_rows, sum(final_su_sum) OVER () AS total_su, sum(final_usd_sum) OVER () AS total_usd
              FROM {p}class_rollup)
        ORDER BY pct_su DESC NULLS LAST"""
    return out


def pair_text(cols: CandidateCols = CandidateCols()) -> str:
    """The two scenarios side by side, over the views ``candidate`` and ``candidate2``."""
    shown = ", ".join(
        f"{side}.`{getattr(cols, attr)}` AS {name}_{k}" for name, attr in scenarios.PAIR_SHOWN.items() for k, side in enumerate(("one", "two"), 1)
    )
    keys = [f"CAST({side}.`{c}` AS STRING)" for c in (cols.product, cols.location) for side in ("one", "two")]
    return (
        f"SELECT {keys[0]} AS product, {keys[2]} AS location, {shown} FROM {{p}}candidate one"
        f" LEFT JOIN {{p}}candidate2 two ON {keys[0]} = {keys[1]} AND {keys[2]} = {keys[3]}"
    )


def create_views(spark: SparkSession, prefix: str = "", *, thresholds: Thresholds = Thresholds(), permanent: bool = False, pair: bool = False) -> list[str]:
    """Create or replace every view, over ``<prefix>comparison``, which must be there; their names.

    ``permanent`` views are kept in the catalog; then the comparison must be a
    table or a permanent view (S7: ``ingest.replace_table``). With ``pair``
    also the scenario pair, over ``<prefix>candidate`` and ``<prefix>candidate2``.
    """
    kind = "VIEW" if permanent else "TEMPORARY VIEW"
    texts = view_texts(thresholds) | ({"scenario_pair": pair_text()} if pair else {})
    for name, text in texts.items():
        spark.sql(f"CREATE OR REPLACE {kind} {prefix}{name} AS {text.format(p=prefix)}")
    return [prefix + name for name in texts]


def sizes(spark: SparkSession, names: list[str], prefix: str = "") -> DataFrame:
    """(view, n) of the named views, as one query."""
    parts = [f"SELECT {_text(n.removeprefix(prefix))} AS view, count(*) AS n FROM {n}" for n in names]
    return spark.sql(" UNION ALL ".join(parts))
