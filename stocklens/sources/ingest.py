"""Reading role tables and writing them back.

Spreadsheet exports are re-aimed to Spark-readable files (parquet or CSV):
executors read them directly, with a declared schema, instead of decoding a
workbook on the driver and shipping its rows to the cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.schema import quoted

# Header clean-up of the exports, applied in this order.
# Characters removed, then replacements.
HEADER_DROP = ["(", ")", ",", ";", "{", "}", "\n", "\t"]
HEADER_REPLACE = [(" ", "_"), ("$", "USD_")]


# Cell texts that mean "no value", as spreadsheet readers take
# them. In text columns "null" stays, for the rules test for that very text.
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan",
]


class HeaderCollision(ValueError):
    """Two raw headers normalise to the same column name."""


def normalize_header(name: str) -> str:
    for ch in HEADER_DROP:
        name = name.replace(ch, "")
    for old, new in HEADER_REPLACE:
        name = name.replace(old, new)
    return name


def normalize_headers(df: DataFrame) -> DataFrame:
    """Rename every column with ``normalize_header`` (metadata only).

    Uses ``toDF``, which renames by position, so headers containing dots or
    backticks need no quoting. Raises ``HeaderCollision`` when two headers map
    to the same name (case-insensitively, as Spark resolves names).
    """
    new = [normalize_header(c) for c in df.columns]
    seen: dict[str, str] = {}
    for raw, norm in zip(df.columns, new):
        key = norm.lower()
        if key in seen:
            raise HeaderCollision(f"{seen[key]!r} and {raw!r} both become {norm!r}")
        seen[key] = raw
    return df.toDF(*new)


def _float_like(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame) -> DataFrame:
    """S3: NaN in any float/double column becomes NULL.

    Spreadsheet gaps may arrive as NaN; Spark orders NaN above every number
    and ``NaN <> 0`` is true, so left as NaN they would leak into comparisons
    that the analysis means to skip for missing values.
    """
    cols: list[Column] = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if _float_like(f.dataType):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _typed(df: DataFrame, name: str, to: T.DataType) -> Column:
    """Column ``name`` as type ``to``. Missing texts are NULL; any other text that is no such value raises with the column's name."""
    c = F.col(quoted(name))
    if not isinstance(df.schema[name].dataType, T.StringType):
        return c.cast(to).alias(name)
    cell = F.when(~F.trim(c).isin(MISSING_TEXT), c)
    if isinstance(to, T.StringType):
        return cell.alias(name)
    cell = F.when(F.trim(cell) != "null", F.trim(cell))
    wrong = F.raise_error(F.concat(F.lit(f"column {name}: not of type {to.simpleString()}: "), cell)).cast(to)
    return F.coalesce(cell.try_cast(to), F.when(cell.isNotNull(), wrong)).alias(name)


def scan_role(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    carry: bool = False,
    file_column: str | None = None,
    **options: str,
) -> DataFrame:
    """One role file into a DataFrame: headers normalised, NaN -> NULL.

    When ``schema`` is given, the normalised columns are cast to it by name
    (missing columns raise), so every role arrives with its declared types.
    With ``carry`` the columns that it does not declare follow as they are.
    ``file_column`` names a column for the file that a row comes from.
    Text cells in ``MISSING_TEXT`` become NULL, in any column; a cell that is
    neither missing nor of the declared type raises with its column's name.

    The cleaning stands between a later filter and the file, so no filter is
    pushed down: clean once, write the role (``Roles.write``), analyse that.
    """
    raw = spark.read.format(fmt).options(**options).load(path)
    if file_column is not None:
        raw = raw.withColumn(file_column, F.col("_metadata.file_path"))
    df = normalize_headers(raw)
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in df.columns]
        if missing:
            raise ValueError(f"{path}: missing columns {missing}")
        declared = set(schema.fieldNames())
        others = [c for c in df.columns if c not in declared and (carry or c == file_column)]
        df = df.select(*[_typed(df, f.name, f.dataType) for f in schema.fields], *[quoted(c) for c in others])
    # after the cast: a text cell "NaN" only becomes a NaN double here
    return nan_to_null(df)


def _same_schema(old: T.StructType, new: T.StructType) -> bool:
    return [(f.name.lower(), f.dataType) for f in old] == [(f.name.lower(), f.dataType) for f in new]


def _keep_schema(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Raise if ``df`` would change the schema of the existing table ``name``."""
    if spark.catalog.tableExists(name):
        old = spark.table(name).schema
        if not _same_schema(old, df.schema):
            raise ValueError(f"schema of {name} would change: {old.simpleString()} -> {df.schema.simpleString()}")


def write_table(df: DataFrame, name: str, allow_schema_change: bool = True) -> None:
    """Overwrite a managed table.

    With ``allow_schema_change`` the table takes the new schema (S5).
    Otherwise an existing table must keep its schema, checked before writing
    (S6), so a changed export fails loudly instead of rewriting the table.
    ``replace_table`` does the same without ever leaving a half-written table.
    """
    spark = df.sparkSession
    if not allow_schema_change and spark.catalog.tableExists(name):
        _keep_schema(spark, name, df)
        df.write.mode("overwrite").insertInto(name, overwrite=True)
        return
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def _own_catalog(name: str) -> bool:
    """Whether ``name`` names a catalog other than the session's, which may replace tables atomically."""
    parts = name.split(".")
    return len(parts) > 2 and parts[0] != "spark_catalog"


def replace_table(df: DataFrame, name: str, *, allow_schema_change: bool = True, path: str | None = None) -> None:
    """Put ``df`` in the place of the table ``name``, all of it or nothing.

    A catalog of its own (three-part name) replaces the table in one step.
    In the session catalog the rows are first written to a table beside it;
    only when that is complete do the names change, and if the second change
    fails the first is undone. A failed write leaves the old table as it was.
    So ``df`` may read the very table that it replaces. Between the two changes
    of names, which move no data, the table is absent for a moment.

    With ``path`` the files go into a new folder under it, and the table is
    external: dropping it leaves its files.
    """
    spark = df.sparkSession
    if not allow_schema_change:
        _keep_schema(spark, name, df)
    if _own_catalog(name):
        df.writeTo(name).createOrReplace()
        return
    mark = uuid.uuid4().hex[:12]
    staged, retired = f"{name}__next_{mark}", f"{name}__last_{mark}"
    try:
        writer = df.write.format("parquet")
        if path is not None:
            writer = writer.option("path", f"{path.rstrip('/')}/{mark}")
        writer.saveAsTable(staged)
        old = spark.catalog.tableExists(name)
        if old:
            spark.sql(f"ALTER TABLE {name} RENAME TO {retired}")
        try:
            spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        except Exception:
            if old:
                spark.sql(f"ALTER TABLE {retired} RENAME TO {name}")
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    if old:
        spark.sql(f"DROP TABLE {retired}")


def replace_snapshots(df: DataFrame, path: str, column: str, *, only: list | None = None) -> None:
    """Put the snapshots that ``df`` holds in the place of those in the history at ``path``; all others stay untouched.

    The history is partitioned by ``column``. Spark writes the new files
    beside it and moves whole partitions in when all tasks are done, so a
    failed write leaves the old ones. ``only`` names the snapshots that ``df``
    may hold: a row of any other raises in the task that meets it, before
    anything is moved.

    Files are sized by bytes: AQE splits a large snapshot and joins small ones.
    """
    if only is not None:
        strange = F.raise_error(F.concat(F.lit(f"a row of another {column} than the ones to be replaced: "), F.coalesce(F.col(quoted(column)).cast("string"), F.lit("NULL"))))
        guarded = F.when(F.col(quoted(column)).isin(only), F.col(quoted(column))).otherwise(strange.cast(df.schema[column].dataType))
        df = df.withColumn(column, guarded)
    rows = df.hint("rebalance", F.col(quoted(column)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name."""
    return spark.table(name)
