"""Print the physical plans of the headline queries, as they look at scale.

Usage: python tools/show_plans.py [sf_dir] > docs/PLANS.md

Broadcast joins are switched off (``autoBroadcastJoinThreshold=-1``) so the
plans show the shape they take when no side is small enough to broadcast --
the 100 TB case -- instead of the all-broadcast plans small test data gets.
The roles are written with ``Roles.write`` first, so scans, pushed filters
and partition filters refer to real files.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stocklens.operators import rollups  # noqa: E402
from stocklens.plans.analysis import Analysis  # noqa: E402
from stocklens.session import local_session, scratch_path  # noqa: E402
from stocklens.sources import fixture  # noqa: E402
from stocklens.sources.fixture import SEGMENT, SNAPSHOT  # noqa: E402
from stocklens.sources.roles import Roles  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n\n")[0]
    scans = re.findall(r"\(\d+\) Scan parquet.*?(?=\n\(\d+\) )", text, re.S)
    keep = []
    for s in scans:
        lines = [ln for ln in s.splitlines()
                 if ln.startswith(("(", "PushedFilters", "PartitionFilters", "ReadSchema"))]
        keep.append("\n".join(lines))
    return head + "\n\n" + "\n\n".join(keep)


def scratch_path_local() -> str:
    import tempfile

    return tempfile.mkdtemp(prefix="stocklens-plans-wh-")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    warehouse = scratch_path_local()
    spark = local_session(8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1",
                                    "spark.sql.warehouse.dir": warehouse})
    path = scratch_path(spark, "plan-roles")
    fixture.fixture_roles(spark, sf_dir).write(path)
    a = Analysis(Roles.read(spark, path), SNAPSHOT, SEGMENT)
    prefix = f"plan_{os.getpid()}_"
    a.roles.save_tables(prefix, buckets=16)
    bucketed = Analysis(Roles.from_tables(spark, prefix), SNAPSHOT, SEGMENT)
    shown = {
        "summary (flagship)": a.summary(),
        "comparison over bucketed role tables (Roles.save_tables, 16 buckets)":
            bucketed.comparison,
        "scorecard (24 counts, one pass)": rollups.scorecard(a.comparison),
        "histograms_all (six histograms, two passes)": a.histograms(),
        "pair (the lineitem aggregate behind the fixture roles)": fixture.pair(spark, sf_dir),
    }
    print("# Physical plans at scale (broadcast joins disabled)\n")
    print(f"Generated by `tools/show_plans.py` on `{sf_dir}`.\n")
    for title, df in shown.items():
        print(f"## {title}\n\n```")
        print(tree(df))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
