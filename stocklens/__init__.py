"""stocklens: compare two inventory recommendations on Spark.

A candidate recommendation is joined to a baseline snapshot at product x
location grain, measured (zero-safe percent differences in units, normalised
units and days), filtered into named populations, counted, totalled,
histogrammed and classified by an ordered rule list, ending in a
share-of-total summary per class. Everything is DataFrame operations.
"""

__version__ = "0.1.0"

from stocklens.plans.analysis import Analysis  # noqa: E402
from stocklens.sources.ingest import scan_role  # noqa: E402
from stocklens.sources.roles import Roles  # noqa: E402

__all__ = ["Analysis", "Roles", "scan_role", "__version__"]
