"""Every core query against its SQL twin, on the smallest tables."""

import os

import duckdb
import pytest

from noteweave.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    found = registry.QUERIES[name](spark, sf)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert normal(map(tuple, found.collect()), found.columns) == normal(cursor.fetchall(), columns)
