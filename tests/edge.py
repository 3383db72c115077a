"""Hand-written role rows for the edge table (FIXTURES section 4)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from stocklens import schema as S
from stocklens.sources.fixture import SNAPSHOT
from stocklens.sources.roles import Roles

OTHER_DAY = dt.date(2000, 1, 1)


def _df(spark, schema, rows):
    return spark.createDataFrame(
        [tuple(r.get(f.name) for f in schema.fields) for r in rows], schema
    )


@dataclass
class Case:
    """One candidate row and the role rows that go with it.

    ``u`` candidate units, ``fac`` factor, ``b`` final SU, ``d`` final days,
    ``tr`` transition type, ``cov`` candidate weekly CoV, ``cv`` baseline CoV,
    ``cfr``/``sl`` achieved and target service, ``B``/``C`` situational
    buckets, ``T`` stock total. ``base`` False: no baseline row at all;
    ``base_day`` another day: baseline only at that snapshot.
    """

    name: str
    u: float | None = 5.0
    fac: float | None = 1.0
    b: float | None = 8.0
    d: float | None = 10.0
    tr: str | None = None
    cov: float | None = None
    cv: float | None = 0.5
    cfr: float | None = None
    sl: float | None = 0.9
    B: float = 0.0
    C: float = 0.0
    T: float = 100.0
    reco: float | None = None
    days: float = 4.0
    base: bool = True
    base_day: dt.date = SNAPSHOT
    with_factor: bool = True
    extra_factor: bool = False

    def candidate(self):
        return {"PartName": self.name, "PartSite": "S", "Safety_StockUnits": self.u,
                "Safety_StockDays": self.days, "Daily_Demandweek_CoV": self.cov,
                "Daily_DemandLT_CoV": 0.1, "TargetService_Level": 0.95,
                "Avg_On_HandUnits": 1.0, "Daily_DemandDirect": 1.0, "Current_On_HandCost": 1.0}

    def baseline(self):
        if not self.base:
            return []
        row = {"PRDID": self.name, "LOCID": "S", "KEYFIGUREDATE": self.base_day,
               "IOSAFETYSTOCKDAYSOFSUPPLY": self.days, "ZFINALSAFETYDAYSOFSUPPLY": self.d,
               "ZRECOMMENDEDSAFETYSTOCK": self.reco if self.reco is not None else self.b,
               "FINALIOSAFETYSTOCK": self.b, "FINALIOSAFETYSTOCKVAL": 2.0,
               "PGSUBSECTOR": "X", "PGTRANSITIONTYPE": self.tr, "CFR": self.cfr,
               "SU_Total_Plant_Stock_T": self.T,
               "SU_Situational_Safety_Brown_B": self.B, "SU_Situational_Cycle_C": self.C}
        for _, attr in S.BUCKETS:
            col = getattr(S.BaselineCols(), attr)
            row.setdefault(col, 1.0)
        return [row]

    def factor(self):
        if not self.with_factor:
            return []
        rows = [{"Material": self.name, "converter_factor": self.fac}]
        return rows * 2 if self.extra_factor else rows

    def cov_rows(self):
        return [] if self.cv is None else [{"PRDID": self.name, "LOCID": "S", "CV": self.cv}]

    def service_rows(self):
        return [] if self.sl is None else [
            {"PRDID": self.name, "LOCID": "S", "Service_Level": self.sl}]


def roles(spark, cases) -> Roles:
    return Roles(
        candidate=_df(spark, S.candidate_schema(), [c.candidate() for c in cases]),
        baseline=_df(spark, S.baseline_schema(), [r for c in cases for r in c.baseline()]),
        factor=_df(spark, S.factor_schema(), [r for c in cases for r in c.factor()]),
        cov=_df(spark, S.cov_schema(), [r for c in cases for r in c.cov_rows()]),
        service=_df(spark, S.service_schema(), [r for c in cases for r in c.service_rows()]),
    )
