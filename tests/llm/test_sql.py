"""The operators that SQL can express, against their SQL twins."""

import os

import duckdb
import pytest

from noteweave.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in os.listdir(sf):
        con.execute(f"create view {table.split('.')[0]} as select * from '{sf}/{table}'")
    found, cursor = registry.QUERIES[name](spark, sf), con.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in order) for r in found.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if isinstance(a[-1], float) else a == b
