"""Every registered query with SQL gives the same rows in DuckDB; the others give their known rows."""

from __future__ import annotations

import duckdb
import pytest

from schemaloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((repr([plain(r[c]) for c in cols]) for r in df.collect()))
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
