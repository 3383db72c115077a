"""What the driver is given as oracle SQL is SQL."""

import __spark_entry__ as E


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in E.oracle_sql().values())
    assert set(E.oracle_sql()) <= set(E.queries())
