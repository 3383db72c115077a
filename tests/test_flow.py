"""The analysis end to end from exported files, as the source notebook runs it.

Role tables are exported as CSV with spreadsheet-style headers, ingested
with ``scan_role`` (header normalisation, NaN -> NULL, declared types), saved
as bucketed managed tables, read back, and analysed; the summary equals the
one computed straight from the derived roles.
"""

import uuid

from conftest import SF001
from stocklens import Analysis, Roles, scan_role
from stocklens import schema as S
from stocklens.sources import ingest

SCHEMAS = {
    "candidate": S.candidate_schema(),
    "baseline": S.baseline_schema(),
    "factor": S.factor_schema(),
    "cov": S.cov_schema(),
    "service": S.service_schema(),
    "candidate2": S.candidate_schema(),
}


def _raw_header(name: str) -> str:
    # an export header that normalises back to ``name``: "_" written as " "
    return name.replace("_", " ")


def test_files_to_summary(spark, tmp_path):
    direct = Analysis.from_tables(spark, SF001)
    loaded = {}
    for role, df in direct.roles.items():
        path = str(tmp_path / role)
        df.toDF(*[_raw_header(c) for c in df.columns]).write.option("header", "true").csv(path)
        loaded[role] = scan_role(spark, path, SCHEMAS[role], fmt="csv", header="true")
        assert loaded[role].schema == SCHEMAS[role]
    prefix = f"flow{uuid.uuid4().hex[:6]}_"
    Roles(**loaded).save_tables(prefix, buckets=4)
    back = Analysis(Roles.from_tables(spark, prefix), direct.snapshot, direct.segment)
    assert sorted(back.summary().collect()) == sorted(direct.summary().collect())
    assert ingest.read_table(spark, prefix + "factor").count() == direct.roles.factor.count()
