"""Every registered query against its DuckDB oracle on sf0.001."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from stocklens.plans import oracle, queries

TABLES = ("lineitem", "supplier", "part")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


SQL = oracle.oracle_sql()
DUCK_TO_SPARK = {"DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BIGINT": "bigint",
                 "INTEGER": "int", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    sdf = queries.queries()[key](spark, SF001)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(SQL[key])
    d_cols = list(rel.columns)
    d_types = dict(zip(d_cols, (DUCK_TO_SPARK.get(str(t), str(t)) for t in rel.types)))
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert {f.name: f.dataType.simpleString() for f in sdf.schema.fields} == d_types
    assert len(s_rows) == len(d_rows)
    assert _bag(sdf.columns, s_rows) == _bag(d_cols, d_rows)


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(SQL)
    assert set(SQL) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and df.columns[0] == "label"
