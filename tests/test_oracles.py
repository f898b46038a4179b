"""Every query with an oracle gives DuckDB's rows at sf0.001."""

import os

import duckdb
import pytest

from framelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
