"""Role schemas and the canonical column names used inside the library.

Each input table plays one *role* (candidate, baseline, factor, cov, service).
Its columns are bound to canonical names once, in ``bind_*``; every operator
downstream only speaks canonical names, so a user whose exports name columns
differently passes another mapping instead of editing operators.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Column names of the recommendation exports, as the planning systems write
# them. They must equal the source data for the scans and joins to bind.


@dataclass(frozen=True)
class CandidateCols:
    product: str = "PartName"
    location: str = "PartSite"
    ss_days: str = "Safety_StockDays"
    ss_units: str = "Safety_StockUnits"
    weekly_cov: str = "Daily_Demandweek_CoV"
    lt_cov: str = "Daily_DemandLT_CoV"
    target_service: str = "TargetService_Level"
    avg_on_hand: str = "Avg_On_HandUnits"
    direct_demand: str = "Daily_DemandDirect"
    on_hand_cost: str = "Current_On_HandCost"


@dataclass(frozen=True)
class BaselineCols:
    product: str = "PRDID"
    location: str = "LOCID"
    snapshot: str = "KEYFIGUREDATE"
    reco_days: str = "IOSAFETYSTOCKDAYSOFSUPPLY"
    final_days: str = "ZFINALSAFETYDAYSOFSUPPLY"
    reco_su: str = "ZRECOMMENDEDSAFETYSTOCK"
    final_su: str = "FINALIOSAFETYSTOCK"
    final_usd: str = "FINALIOSAFETYSTOCKVAL"
    subsector: str = "PGSUBSECTOR"
    transition_type: str = "PGTRANSITIONTYPE"
    cfr: str = "CFR"
    stock_total: str = "SU_Total_Plant_Stock_T"
    b_red: str = "SU_Red_R"
    b_orange: str = "SU_Orange_O"
    b_anticipation: str = "SU_Anticipation_A"
    b_frozen_transit: str = "SU_Frozen_In_Transit_F"
    b_frozen_qi: str = "SU_Frozen_QI_Q"
    b_amber: str = "SU_Amber_M"
    b_snd_excess: str = "SU_SND_Excess_D"
    b_situational_safety: str = "SU_Situational_Safety_Brown_B"
    b_launch_excess: str = "SU_Launch_Excess_L"
    b_productive_safety: str = "SU_Productive_Safety_S"
    b_excess: str = "SU_Excess_Y"
    b_param_cycle: str = "SU_Parameter_Driven_Cycle_P"
    b_situational_cycle: str = "SU_Situational_Cycle_C"
    b_unknown: str = "SU_Unknown_U"


@dataclass(frozen=True)
class FactorCols:
    product: str = "Material"
    factor: str = "converter_factor"


@dataclass(frozen=True)
class CovCols:
    product: str = "PRDID"
    location: str = "LOCID"
    cov: str = "CV"


@dataclass(frozen=True)
class ServiceCols:
    product: str = "PRDID"
    location: str = "LOCID"
    service_level: str = "Service_Level"


# Flag values written by the comparison (P9-P11) and read by the rule ladder.
YES = "YES"
NO = "NO"
NO_CFR_INFO = "no info about CFR"
# Literal string some exports write instead of a missing transition type.
NULL_STRING = "null"
# --- end of fixed values ----------------------------------------------------

# Canonical bucket names in export order (canonical name, attribute above).
BUCKETS = (
    ("bucket_red", "b_red"),
    ("bucket_orange", "b_orange"),
    ("bucket_anticipation", "b_anticipation"),
    ("bucket_frozen_transit", "b_frozen_transit"),
    ("bucket_frozen_qi", "b_frozen_qi"),
    ("bucket_amber", "b_amber"),
    ("bucket_snd_excess", "b_snd_excess"),
    ("bucket_situational_safety", "b_situational_safety"),
    ("bucket_launch_excess", "b_launch_excess"),
    ("bucket_productive_safety", "b_productive_safety"),
    ("bucket_excess", "b_excess"),
    ("bucket_param_cycle", "b_param_cycle"),
    ("bucket_situational_cycle", "b_situational_cycle"),
    ("bucket_unknown", "b_unknown"),
)
BUCKET_NAMES = tuple(name for name, _ in BUCKETS)


def _struct(cols, key_types: dict[str, T.DataType]) -> T.StructType:
    """Declared schema of a role: keys as given, every other column double."""
    out = []
    for f in fields(cols):
        name = getattr(cols, f.name)
        out.append(T.StructField(name, key_types.get(f.name, T.DoubleType()), True))
    return T.StructType(out)


def candidate_schema(cols: CandidateCols = CandidateCols()) -> T.StructType:
    return _struct(cols, {"product": T.StringType(), "location": T.StringType()})


def baseline_schema(cols: BaselineCols = BaselineCols()) -> T.StructType:
    return _struct(
        cols,
        {
            "product": T.StringType(),
            "location": T.StringType(),
            "snapshot": T.DateType(),
            "subsector": T.StringType(),
            "transition_type": T.StringType(),
        },
    )


def factor_schema(cols: FactorCols = FactorCols()) -> T.StructType:
    return _struct(cols, {"product": T.StringType()})


def cov_schema(cols: CovCols = CovCols()) -> T.StructType:
    return _struct(cols, {"product": T.StringType(), "location": T.StringType()})


def service_schema(cols: ServiceCols = ServiceCols()) -> T.StructType:
    return _struct(cols, {"product": T.StringType(), "location": T.StringType()})


# Attributes that are join keys in every role.
KEY_ATTRS = ("product", "location")


# Prefix under which a role's undeclared columns travel through the joins.
CARRIED = "carried_"


def quoted(name: str) -> str:
    """``name`` as a column reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def undeclared(df: DataFrame, cols) -> list[str]:
    """The columns of a role table that the role does not declare, in their order."""
    declared = {getattr(cols, f.name).lower() for f in fields(cols)}
    return [c for c in df.columns if c.lower() not in declared]


def bind(
    df: DataFrame, cols, prefix: str, rename: dict[str, str] | None = None, carry: bool = False
) -> DataFrame:
    """Project a role table onto canonical names ``prefix + attribute``.

    With ``carry`` its undeclared columns come along, as ``carried_<prefix><name>``.

    A ``Project`` of column references (keys cast to text, a no-op for text
    keys): Catalyst prunes what later operators do not read, so binding costs
    nothing at the scan.
    """
    rename = rename or {}
    out = []
    for f in fields(cols):
        c = F.col(f"`{getattr(cols, f.name)}`")
        if f.name in KEY_ATTRS:
            # keys are text on every side: an export with numeric ids must
            # not make the join cast the other side's text ids to numbers
            c = c.cast("string")
        out.append(c.alias(rename.get(f.name, prefix + f.name)))
    if carry:
        out += [F.col(quoted(c)).alias(f"{CARRIED}{prefix}{c}") for c in undeclared(df, cols)]
    return df.select(*out)



def bind_candidate(df: DataFrame, cols: CandidateCols = CandidateCols(), carry: bool = False) -> DataFrame:
    return bind(df, cols, "k_", carry=carry)


def bind_baseline(df: DataFrame, cols: BaselineCols = BaselineCols(), carry: bool = False) -> DataFrame:
    rename = {attr: name for name, attr in BUCKETS}
    return bind(df, cols, "i_", rename, carry=carry)


def bind_factor(df: DataFrame, cols: FactorCols = FactorCols()) -> DataFrame:
    return bind(df, cols, "c_")


def bind_cov(df: DataFrame, cols: CovCols = CovCols()) -> DataFrame:
    return bind(df, cols, "cv_")


def bind_service(df: DataFrame, cols: ServiceCols = ServiceCols()) -> DataFrame:
    return bind(df, cols, "sl_")
