"""The set of role tables one comparison reads."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens import schema as S
from stocklens.sources.history import SnapshotHistory

ROLE_SCHEMAS = {
    "candidate": S.candidate_schema,
    "baseline": S.baseline_schema,
    "factor": S.factor_schema,
    "cov": S.cov_schema,
    "service": S.service_schema,
    "candidate2": S.candidate_schema,
}


def _declared(name: str, df: DataFrame) -> DataFrame:
    """``df`` with its declared columns cast to their declared types: what ``validate`` accepts, ``read`` must find."""
    types = {f.name: f.dataType for f in ROLE_SCHEMAS[name]().fields}
    return df.select(*[F.col(S.quoted(c)).cast(types[c]).alias(c) if c in types else F.col(S.quoted(c)) for c in df.columns])


@dataclass(frozen=True)
class Roles:
    """Role tables in their export column names (see ``schema``).

    ``candidate2`` is the optional second candidate scenario.
    """

    candidate: DataFrame
    baseline: DataFrame
    factor: DataFrame
    cov: DataFrame
    service: DataFrame
    candidate2: DataFrame | None = None

    def items(self):
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None:
                yield f.name, df

    def write(self, path: str) -> None:
        """Overwrite every role as a parquet table under ``path``.

        This is the lineage cut: later analyses read files, so a lost executor
        costs a re-read, not a re-run of the derivation.

        The baseline is partitioned by its snapshot date: a history of many
        snapshots then answers the snapshot predicate by partition pruning
        (only the chosen day's folder is listed and read). Files are sized by
        bytes (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): AQE splits
        large snapshots and joins small ones before they are written.
        ``replace_snapshots`` renews some days of the baseline alone.
        """
        for name, df in self.items():
            df = _declared(name, df)
            if name == "baseline":
                SnapshotHistory.write(df, f"{path}/{name}")
            else:
                df.hint("rebalance").write.mode("overwrite").parquet(f"{path}/{name}")

    def replace_snapshots(self, path: str) -> None:
        """Under ``path``, where ``write`` has put roles, renew the snapshots that this baseline holds; nothing else is touched."""
        SnapshotHistory(self.baseline.sparkSession, f"{path}/baseline").replace(_declared("baseline", self.baseline))

    @staticmethod
    def read(spark: SparkSession, path: str, with_candidate2: bool = True) -> "Roles":
        """Read roles written by ``write`` with their declared schemas."""
        out = {}
        for name, schema_fn in ROLE_SCHEMAS.items():
            if name == "candidate2" and not with_candidate2:
                continue
            declared = schema_fn()
            # a declared schema makes Spark fill absent columns with NULL,
            # which this analysis would read as "missing value": check first
            # (file footers and folder names only, no data is read)
            there = spark.read.parquet(f"{path}/{name}").schema.fields
            found, known = {f.name for f in there}, {c.lower() for c in declared.fieldNames()}
            missing = [c for c in declared.fieldNames() if c not in found]
            if missing:
                raise ValueError(f"{path}/{name}: missing columns {missing}")
            # declared columns first, in their order; undeclared ones follow
            others = [f for f in there if f.name.lower() not in known]
            df = spark.read.schema(T.StructType([*declared.fields, *others])).parquet(f"{path}/{name}")
            out[name] = df.select(*[S.quoted(c) for c in [*declared.fieldNames(), *[f.name for f in others]]])
        return Roles(**out)

    def save_tables(self, prefix: str, buckets: int | None = None) -> list[str]:
        """Save every role as a managed table ``<prefix><role>``.

        With ``buckets`` the tables keyed by (product, location) -- candidate,
        baseline, CoV, service level, second candidate -- are bucketed and
        sorted on those keys with the same bucket count. Role tables are
        written once and joined on every analysis run; bucketed alike, the
        three same-key joins of the comparison read co-located buckets and
        need no exchange for the candidate, CoV and service sides. The
        baseline is also partitioned by snapshot date, as in ``write``. Rows
        are dealt to the buckets before they are written, so a bucket is one
        file per snapshot, not one per task.
        """
        names = []
        for name, df in self.items():
            keys = _site_keys(name)
            df = _declared(name, df)
            if buckets and keys:
                df = df.repartition(buckets, *keys)
            writer = df.write.mode("overwrite").format("parquet")
            if name == "baseline":
                writer = writer.partitionBy(S.BaselineCols().snapshot)
            if buckets and keys:
                writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
            writer.saveAsTable(prefix + name)
            names.append(prefix + name)
        return names

    @staticmethod
    def from_tables(spark: SparkSession, prefix: str, with_candidate2: bool = True) -> "Roles":
        """Roles saved by ``save_tables`` (S9), in their declared column order."""
        out = {}
        for name, schema_fn in ROLE_SCHEMAS.items():
            if name == "candidate2" and not with_candidate2:
                continue
            table, declared = spark.table(prefix + name), schema_fn().fieldNames()
            others = [c for c in table.columns if c.lower() not in {d.lower() for d in declared}]
            out[name] = table.select(*[S.quoted(c) for c in [*declared, *others]])
        return Roles(**out)

    def conform(
        self,
        candidate: S.CandidateCols | None = None,
        baseline: S.BaselineCols | None = None,
        factor: S.FactorCols | None = None,
        cov: S.CovCols | None = None,
        service: S.ServiceCols | None = None,
    ) -> "Roles":
        """Roles whose columns are named differently, renamed to the defaults.

        Pass, per role, the column names your tables use (e.g.
        ``CandidateCols(product="sku", location="site", ...)``). The result is
        a projection per role -- no data moves -- after which every operator
        reads the default names. The second candidate follows ``candidate``.
        Columns that are not named stay as they are; one that has the default
        name of another raises.
        """
        mapping = {"candidate": candidate, "candidate2": candidate, "baseline": baseline,
                   "factor": factor, "cov": cov, "service": service}
        defaults = {"candidate": S.CandidateCols(), "candidate2": S.CandidateCols(),
                    "baseline": S.BaselineCols(), "factor": S.FactorCols(),
                    "cov": S.CovCols(), "service": S.ServiceCols()}
        out = {}
        for name, df in self.items():
            given = mapping[name]
            if given is None:
                out[name] = df
                continue
            named = {getattr(given, f.name): getattr(defaults[name], f.name) for f in fields(given)}
            others = [c for c in df.columns if c not in named]
            twice = {c.lower() for c in named.values()} & {c.lower() for c in others}
            if twice:
                raise ValueError(f"{name}: columns {sorted(twice)} are there besides those named so; rename or drop them")
            out[name] = df.select(*[F.col(S.quoted(c)).alias(to) for c, to in named.items()], *[S.quoted(c) for c in others])
        return Roles(**out)

    def validate(self) -> "Roles":
        """Check every role against its declared schema (metadata only).

        Each declared column must exist. Measures must be numeric; the
        snapshot must be a date or timestamp. Keys may be of any type
        (they are compared as text). Raises ``ValueError`` naming what is
        wrong, before any job runs.
        """
        problems = []
        for name, df in self.items():
            have = {f.name: f.dataType for f in df.schema.fields}
            for f in ROLE_SCHEMAS[name]().fields:
                if f.name not in have:
                    problems.append(f"{name}.{f.name}: missing")
                    continue
                got = have[f.name]
                if isinstance(f.dataType, T.DoubleType) and not isinstance(got, T.NumericType):
                    problems.append(f"{name}.{f.name}: {got.simpleString()} is not numeric")
                if isinstance(f.dataType, T.DateType) and not isinstance(
                    got, (T.DateType, T.TimestampType, T.TimestampNTZType)
                ):
                    problems.append(f"{name}.{f.name}: {got.simpleString()} is not a date")
        if problems:
            raise ValueError("role tables do not match their schemas: " + "; ".join(problems))
        return self

    def with_candidate(self, df: DataFrame) -> "Roles":
        return replace(self, candidate=df)


def _site_keys(role: str) -> tuple[str, ...]:
    """(product, location) export columns of a role, empty for the factor."""
    cols = {
        "candidate": S.CandidateCols(),
        "candidate2": S.CandidateCols(),
        "baseline": S.BaselineCols(),
        "cov": S.CovCols(),
        "service": S.ServiceCols(),
    }.get(role)
    return () if cols is None else (cols.product, cols.location)
