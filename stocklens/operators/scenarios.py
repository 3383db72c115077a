"""Scenario selection and the two-scenario side-by-side view.

A scenario is one candidate table. ``select_scenario`` tags each scenario with
its name and unions them; a filter on the name folds to ``false`` on every
other branch at planning time, so only the chosen scenario's files are read.

``ScenarioFiles`` is the same for scenarios that are files: a catalog of names
and paths. A path is listed and its schema read only when its scenario is
asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens import schema as S
from stocklens.operators.skew import left_join
from stocklens.sources import ingest

# Columns that tell a row's scenario and file.
SCENARIO, SOURCE_FILE = "scenario", "source_file"

# Shown of both scenarios, as ``<name>_1`` and ``<name>_2``: output name ->
# candidate attribute. "Stock units" are the average on-hand units, as the
# analysis defines them.
PAIR_SHOWN = {
    "stock_units": "avg_on_hand",
    "target_service": "target_service",
    "direct_demand": "direct_demand",
    "weekly_cov": "weekly_cov",
    "lt_cov": "lt_cov",
}


def select_scenario(scenarios: dict[str, DataFrame], name: str) -> DataFrame:
    """Candidate rows of scenario ``name``, with a ``scenario`` column."""
    if name not in scenarios:
        raise KeyError(f"unknown scenario {name!r}; known: {sorted(scenarios)}")
    tagged = None
    for key, df in scenarios.items():
        part = df.withColumn("scenario", F.lit(key))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.filter(F.col("scenario") == F.lit(name))


_WIDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _common(name: str, one: tuple[str, T.DataType], two: tuple[str, T.DataType]) -> T.DataType:
    """The type that holds a column of two scenarios; raises with both where there is none."""
    (where, a), (there, b) = one, two
    if a == b:
        return a
    places = [next((k for k, t in enumerate(_WIDER) if isinstance(x, t)), None) for x in (a, b)]
    if None in places:
        raise ValueError(f"column {name} is {a.simpleString()} in scenario {where} and {b.simpleString()} in {there}")
    wide = _WIDER[max(places)]()
    # a float holds no int exactly, a double no long: the former two meet in a double
    return T.DoubleType() if isinstance(wide, T.FloatType) else wide


@dataclass(frozen=True)
class ScenarioFiles:
    """Scenarios by path, all alternatives of one candidate role.

    ``paths`` maps a scenario's name to its files, in the format ``fmt``.
    Rows come with the role's declared columns, cast and cleaned as
    ``ingest.scan_role`` does, then the file's other columns, then
    ``scenario`` and ``source_file``.
    """

    spark: SparkSession
    paths: Mapping[str, str]
    fmt: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType = field(default_factory=S.candidate_schema)

    def select(self, name: str) -> DataFrame:
        """One scenario; no other path is listed."""
        if name not in self.paths:
            raise KeyError(f"unknown scenario {name!r}; known: {sorted(self.paths)}")
        df = ingest.scan_role(self.spark, self.paths[name], self.schema, self.fmt, carry=True, file_column=SOURCE_FILE, **self.options)
        if SCENARIO in {c.lower() for c in df.columns}:
            raise ValueError(f"{self.paths[name]}: has a column named {SCENARIO} of its own")
        others = [c for c in df.columns if c != SOURCE_FILE]
        return df.select(*[S.quoted(c) for c in others], F.lit(name).alias(SCENARIO), SOURCE_FILE)

    def merged(self, names: Sequence[str] | None = None) -> DataFrame:
        """Several scenarios (default: all) in one table, columns matched by name.

        A column that a scenario lacks is NULL there. Numbers of different
        widths meet in the wider type; other types that differ raise. A
        filter on ``scenario`` leaves the other files unread.
        """
        names = list(self.paths) if names is None else list(names)
        if not names:
            raise ValueError("no scenario is named")
        parts = {name: self.select(name) for name in names}
        columns: dict[str, tuple[str, str, T.DataType]] = {}
        for name, df in parts.items():
            for f in df.schema.fields:
                known = columns.get(f.name.lower())
                kind = f.dataType if known is None else _common(f.name, known[1:], (name, f.dataType))
                columns[f.name.lower()] = (known[0] if known else f.name, known[1] if known else name, kind)
        for last in (SCENARIO, SOURCE_FILE):
            columns[last] = columns.pop(last)
        out = None
        for df in parts.values():
            own = {c.lower(): c for c in df.columns}
            cells = [(F.col(S.quoted(own[key])) if key in own else F.lit(None)).cast(kind).alias(shown) for key, (shown, _, kind) in columns.items()]
            out = df.select(*cells) if out is None else out.unionByName(df.select(*cells))
        return out

    def pair(self, one: str, two: str) -> DataFrame:
        """J8 + P16 of two of the scenarios."""
        return scenario_pair(self.select(one), self.select(two))


def scenario_pair(
    one: DataFrame,
    two: DataFrame,
    cols: S.CandidateCols = S.CandidateCols(),
    hot_rows: int | None = None,
) -> DataFrame:
    """J8 + P16: scenario one LEFT JOIN scenario two on (product, location).

    ``hot_rows``: keys that the second holds in more rows are split (``operators.skew``).
    """
    a = S.bind(one, cols, "one_")
    b = S.bind(two, cols, "two_")
    j = left_join(a, b, [("one_product", "two_product"), ("one_location", "two_location")], rows=hot_rows)
    shown = [
        F.col(f"{side}_{attr}").alias(f"{name}_{k}")
        for name, attr in PAIR_SHOWN.items()
        for k, side in enumerate(("one", "two"), 1)
    ]
    return j.select(F.col("one_product").alias("product"), F.col("one_location").alias("location"), *shown)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """L1/L2: the first ``n`` rows in key order (a top-k, not a full sort)."""
    return df.orderBy(*order).limit(n)
