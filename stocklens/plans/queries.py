"""Registry: query key -> DataFrame built from an ``Analysis``.

Keys follow the operator inventory (SURVEY section 2). Each entry is a
function of an ``Analysis`` so the same query runs on roles derived from the
driver tables, on materialised role tables, or on a user's own tables.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.operators import compare, populations, rollups, scenarios
from stocklens.plans import views
from stocklens.plans.analysis import Analysis
from stocklens.session import scratch_path
from stocklens.sources import fixture, ingest
from stocklens.sources.fixture import read_table
from stocklens.sources.history import SnapshotHistory

KEY_COLS = ("product", "location")

QueryFn = Callable[[Analysis], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def _reg(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn

    return deco


def _keyed(cmp: DataFrame, *cols: str) -> DataFrame:
    return cmp.select(*KEY_COLS, *cols)


# --- sources / roles (S1-S4, roles of FIXTURES section 3) --------------------
for _role in ("candidate", "baseline", "factor", "cov", "service", "candidate2"):
    REGISTRY[f"role_{_role}"] = (lambda r: lambda a: getattr(a.roles, r))(_role)


@_reg("nan_to_null")
def _nan_to_null(a: Analysis) -> DataFrame:
    """S3: zero CoVs and the days of one-line products come as NaN."""
    nan = F.lit(float("nan"))
    dirty = a.roles.candidate.withColumns({
        "Daily_DemandLT_CoV": F.when(F.col("Daily_DemandLT_CoV") == 0, nan).otherwise(F.col("Daily_DemandLT_CoV")),
        "Safety_StockDays": F.when(F.col("Daily_DemandDirect") == 1, nan).otherwise(F.col("Safety_StockDays")),
    })
    return ingest.nan_to_null(dirty)


@_reg("normalize_headers")
def _normalize_headers(a: Analysis) -> DataFrame:
    """The candidate with the headers of a spreadsheet export."""
    raw = ["Part(Name)", "Part{Site}", "Safety Stock\n(Units)", "Safety Stock\t(Days)", "Daily Demand;week CoV",
           "Daily Demand(LT) CoV", "Target,Service Level", "Avg On Hand(Units)", "Daily Demand{Direct}",
           "Current On Hand,(Cost);", "Cost ($)"]
    exported = a.roles.candidate.withColumn("cost", F.col("Current_On_HandCost")).toDF(*raw)
    return ingest.normalize_headers(exported)


@_reg("table_round_trip")
def _table_round_trip(a: Analysis) -> DataFrame:
    """A table overwritten with its schema kept, then with a wider one, and read by name."""
    spark, factor = a.roles.factor.sparkSession, a.roles.factor
    name, folder = f"stocklens_round_trip_{uuid.uuid4().hex[:12]}", scratch_path(spark, "round-trip")
    ingest.replace_table(factor.filter(F.lit(False)), name, path=folder)
    ingest.replace_table(factor, name, allow_schema_change=False, path=folder)
    wider = ingest.read_table(spark, name).withColumn("note", F.concat_ws("/", "Material", "converter_factor"))
    ingest.replace_table(wider, name, path=folder)  # reads the table that it replaces
    files = ingest.read_table(spark, name).inputFiles()
    spark.sql(f"DROP TABLE {name}")  # the files stay in scratch; no table is left in the catalog
    return spark.read.parquet(*sorted({f.rsplit("/", 1)[0] for f in files}))


@_reg("scenario_select")
def _scenario_select(a: Analysis) -> DataFrame:
    return scenarios.select_scenario(a.scenario_catalog(), "second")


def _scenario_files(a: Analysis) -> scenarios.ScenarioFiles:
    """Both candidates written as files of their own, the second with columns that the first lacks and the other way round."""
    spark = a.roles.candidate.sparkSession
    root = scratch_path(spark, "scenarios")
    first = a.roles.candidate.withColumn("Locked_Weeks", F.col("Daily_DemandDirect").cast("int"))
    second = a.roles.candidate2.withColumn("Calibrated_On", F.col("PartSite")).withColumn("Locked_Weeks", F.col("Safety_StockDays"))
    first.write.parquet(f"{root}/service_optimised")
    second.write.parquet(f"{root}/on_hand_calibrated")
    return scenarios.ScenarioFiles(spark, {n: f"{root}/{n}" for n in ("service_optimised", "on_hand_calibrated")})


@_reg("scenario_files")
def _scenario_files_merged(a: Analysis) -> DataFrame:
    """Two scenarios by path in one table, each row with the folder of its file."""
    merged = _scenario_files(a).merged()
    return merged.withColumn("source_file", F.element_at(F.split("source_file", "/"), -2))


@_reg("scenario_file_select")
def _scenario_file_select(a: Analysis) -> DataFrame:
    """One scenario by path."""
    return _scenario_files(a).select("on_hand_calibrated").drop("source_file")


# --- comparison, joins, measures (S7, J1-J4, P1-P7, F1) -----------------------
REGISTRY["comparison"] = lambda a: a.comparison
REGISTRY["join_concat_key"] = lambda a: compare.comparison_concat_key(a.roles, a.snapshot)
REGISTRY["unmatched"] = lambda a: compare.unmatched(a.roles, a.snapshot)
REGISTRY["join_snapshot"] = lambda a: _keyed(
    a.comparison, "base_product", "base_location", "snapshot_date", "reco_days", "final_days",
    "reco_su", "final_su", "final_usd", "subsector", "transition_type", "cfr",
)
REGISTRY["join_factor"] = lambda a: _keyed(a.comparison, "base_product", "factor")
REGISTRY["join_cov"] = lambda a: _keyed(a.comparison, "base_cov")
REGISTRY["join_service"] = lambda a: _keyed(a.comparison, "service_level")
REGISTRY["unit_to_su"] = lambda a: _keyed(a.comparison, "cand_units", "factor", "cand_su")
REGISTRY["su_to_unit"] = lambda a: _keyed(
    a.comparison, "factor", "reco_su", "reco_units", "final_su", "final_units"
)
for _key, _col in {
    "diff_reco_days": "reco_days_diff",
    "diff_final_days": "final_days_diff",
    "diff_reco_units": "reco_units_diff",
    "diff_reco_su": "reco_su_diff",
    "diff_final_units": "final_units_diff",
    "diff_final_su": "final_su_diff",
    "diff_final_su_cycle": "final_su_cycle_diff",
    "cycle_ratio": "cycle_ratio",
    "cand_su_cycle": "cand_su_cycle",
}.items():
    REGISTRY[_key] = (lambda c: lambda a: _keyed(a.comparison, c))(_col)


@_reg("star_projection")
def _star_projection(a: Analysis) -> DataFrame:
    """Columns that no role declares, of both sides, on the classified rows."""
    k, i = a.roles.candidate, a.roles.baseline
    roles = replace(
        a.roles,
        candidate=k.withColumn("Planner_Site", F.concat_ws("@", "PartName", "PartSite")).withColumn("Demand_Rank", F.col("Daily_DemandDirect") * 2),
        baseline=i.withColumn("Review_Round", F.concat_ws("/", F.year("KEYFIGUREDATE").cast("string"), "PGSUBSECTOR")),
    )
    return Analysis(roles, a.snapshot, a.segment).classified


def _hot(a: Analysis) -> Analysis:
    """The analysis with a third of the CoV rows, and of the second scenario's, on one key, and that key split."""
    k = a.roles.candidate
    first = k.select(F.min(F.struct("PartName", "PartSite"))).scalar()
    cov, two = a.roles.cov, a.roles.candidate2
    moved = F.col("CV") <= 0.5
    cov = cov.withColumns({c: F.when(moved, first.getField(k)).otherwise(F.col(c)) for c, k in (("PRDID", "PartName"), ("LOCID", "PartSite"))})
    moved = F.col("Daily_Demandweek_CoV") <= 0.4
    two = two.withColumns({c: F.when(moved, first.getField(c)).otherwise(F.col(c)) for c in ("PartName", "PartSite")})
    return Analysis(replace(a.roles, cov=cov, candidate2=two), a.snapshot, a.segment, hot_rows=200)


@_reg("join_hot_key")
def _join_hot_key(a: Analysis) -> DataFrame:
    """J1, J3, J4 with a hot key on the right side of J3."""
    return _keyed(_hot(a).comparison, "base_product", "base_cov", "service_level", "final_su_diff")


@_reg("pair_hot_key")
def _pair_hot_key(a: Analysis) -> DataFrame:
    """J8 with a hot key in the second scenario."""
    return _hot(a).scenario_pair()


# --- populations (F2-F7) ------------------------------------------------------
REGISTRY["pop_existing"] = lambda a: populations.existing(a.comparison)
REGISTRY["pop_final_units"] = lambda a: populations.final_units(a.comparison)
REGISTRY["pop_final_su"] = lambda a: populations.final_su(a.comparison)
REGISTRY["pop_reco"] = lambda a: populations.reco(a.comparison)
REGISTRY["pop_nonzero"] = lambda a: populations.nonzero_candidate(a.comparison)
REGISTRY["count_segment_snapshot"] = lambda a: a.segment_snapshot_count()

# --- counts (C2-C25), scorecard, contingency ----------------------------------
for _key in rollups.COUNT_KEYS:
    REGISTRY[_key] = (lambda k: lambda a: rollups.count(a.comparison, k))(_key)
REGISTRY["scorecard"] = lambda a: rollups.scorecard(a.comparison)
REGISTRY["contingency_reco"] = lambda a: rollups.contingency(a.comparison, "reco")
REGISTRY["contingency_final"] = lambda a: rollups.contingency(a.comparison, "final")

# --- sums and buckets (A1-A10) -----------------------------------------------
REGISTRY["min_snapshot"] = lambda a: a.min_snapshot()
REGISTRY["totals_existing"] = lambda a: rollups.totals_existing(a.comparison)
REGISTRY["totals_su_nonzero"] = lambda a: rollups.totals_su_nonzero(a.comparison)
REGISTRY["buckets_nonzero"] = lambda a: rollups.buckets_nonzero(a.comparison)
REGISTRY["bucket_reconcile"] = lambda a: rollups.bucket_reconcile(a.comparison)
REGISTRY["buckets_all"] = lambda a: rollups.buckets_all(a.comparison)
REGISTRY["totals_units"] = lambda a: rollups.totals_units(a.comparison)
REGISTRY["grand_totals"] = lambda a: a.grand_totals()
REGISTRY["sums_card"] = lambda a: rollups.sums_card(a.comparison)

# --- flags, classes, summary (P8-P15, A11-A12, J5-J7, O1) --------------------
REGISTRY["flags"] = lambda a: a.flagged
REGISTRY["classified"] = lambda a: a.classified
REGISTRY["class_rollup"] = lambda a: rollups.class_rollup(a.classified)
REGISTRY["class_codes"] = lambda a: a.classified.groupBy("code", "label").agg(
    F.count(F.lit(1)).alias("n_rows")
)
REGISTRY["summary"] = lambda a: a.summary()


@_reg("summary_ranked")
def _summary_ranked(a: Analysis) -> DataFrame:
    """O1: the summary (at most 21 rows) with each row's place in its order."""
    return a.summary().withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("pct_su"))))


# --- histograms (H2-H9) -------------------------------------------------------
for _key in ("hist_final_su", "hist_final_su_cycle", "hist_reco_su", "hist_final_days",
             "hist_reco_days", "hist_cov"):
    REGISTRY[_key] = (lambda k: lambda a: a.histogram(k))(_key)
REGISTRY["histograms_all"] = lambda a: a.histograms()

# --- scenarios, limits (J8, P16, L1, L2) -------------------------------------
REGISTRY["scenario_pair"] = lambda a: a.scenario_pair()
REGISTRY["scenario_pair_top10"] = lambda a: scenarios.first_rows(
    a.scenario_pair(), 10, "product", "location"
)
REGISTRY["preview"] = lambda a: scenarios.first_rows(a.roles.candidate, 5, "PartName", "PartSite")


def scan_role_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on an export of ``part``: text cells under raw headers, with the gaps that spreadsheets leave."""
    size = F.col("p_size")

    def cell(column: str, gaps: dict[int, str]):
        text = F.col(column).cast("string")
        for of_size, gap in gaps.items():
            text = F.when(size == of_size, F.lit(gap)).otherwise(text)
        return text

    export = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("Part Key"),
        cell("p_name", {3: "#N/A", 6: "N/A", 9: ""}).alias("Part Name"),
        cell("p_size", {1: "#N/A", 2: "N/A", 3: "", 4: "NaN", 5: " NULL "}).alias("Part\n(Size)"),
        cell("p_retailprice", {6: "NaN", 7: "#N/A", 8: ""}).alias("Retail Price ($)"),
    )
    path = scratch_path(spark, "part-export")
    export.write.parquet(path)
    declared = T.StructType([
        T.StructField("Part_Key", T.LongType()),
        T.StructField("Part_Name", T.StringType()),
        T.StructField("PartSize", T.IntegerType()),
        T.StructField("Retail_Price_USD_", T.DoubleType()),
    ])
    return ingest.scan_role(spark, path, declared)


# --- SQL text over views (S8) ---------------------------------------------------
def _views(a: Analysis) -> tuple[SparkSession, str, list[str]]:
    spark, prefix = a.roles.candidate.sparkSession, "stocklens_text_"
    a.comparison.createOrReplaceTempView(f"{prefix}comparison")
    a.roles.candidate.createOrReplaceTempView(f"{prefix}candidate")
    a.roles.candidate2.createOrReplaceTempView(f"{prefix}candidate2")
    return spark, prefix, views.create_views(spark, prefix, pair=True)


@_reg("summary_by_sql")
def _summary_by_sql(a: Analysis) -> DataFrame:
    """The summary, through SQL text over views over views."""
    spark, prefix, _ = _views(a)
    return spark.sql(f"SELECT * FROM {prefix}summary")


@_reg("classified_by_sql")
def _classified_by_sql(a: Analysis) -> DataFrame:
    """The classified rows, through SQL text."""
    spark, prefix, _ = _views(a)
    return spark.sql(f"SELECT * FROM {prefix}classified")


@_reg("pair_by_sql")
def _pair_by_sql(a: Analysis) -> DataFrame:
    """The scenario pair, through SQL text."""
    spark, prefix, _ = _views(a)
    return spark.sql(f"SELECT * FROM {prefix}scenario_pair")


@_reg("view_sizes")
def _view_sizes(a: Analysis) -> DataFrame:
    """The rows of every view."""
    spark, prefix, names = _views(a)
    return views.sizes(spark, names, prefix)


def describe_comparison(a: Analysis) -> DataFrame:
    return compare.describe(a.comparison)


REGISTRY["describe_comparison"] = describe_comparison


# --- a history of snapshots by the tables' own dates (F7, J1, A1, S7) ------------
HISTORY: dict[str, QueryFn] = {
    "history_segment_count": lambda a: a.segment_snapshot_count(),
    "history_join": lambda a: REGISTRY["join_snapshot"](a),
    "history_summary": lambda a: a.summary(),
}


def history_min_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over the history, from its listing."""
    return fixture.staged_history(spark, sf_dir).earliest()


def history_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of which one snapshot was replaced in place; rows and stock of every snapshot."""
    staged = fixture.staged_history(spark, sf_dir)
    own = SnapshotHistory.write(staged.rows(), scratch_path(spark, "replaced-history"))
    earliest = staged.rows().filter(F.col(own.column) == staged.dates().agg(F.min("snapshot_date")).scalar())
    own.replace(earliest.filter("FINALIOSAFETYSTOCK IS NOT NULL").withColumn("FINALIOSAFETYSTOCK", F.col("FINALIOSAFETYSTOCK") * 2))
    return SnapshotHistory(spark, own.path).rows().groupBy(F.col(own.column).alias("snapshot_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("FINALIOSAFETYSTOCK").alias("final_su")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``(spark, sf_dir) -> DataFrame`` per key, each over the whole tables."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for key, fn in REGISTRY.items():
        out[key] = (lambda f: lambda spark, sf_dir: f(Analysis.from_tables(spark, sf_dir)))(fn)
    for key, fn in HISTORY.items():
        out[key] = (lambda f: lambda spark, sf_dir: f(Analysis.from_history(spark, sf_dir)))(fn)
    out["history_min_snapshot"] = history_min_snapshot
    out["history_replaced"] = history_replaced
    out["scan_role"] = scan_role_query
    return out
