"""Every query against its SQL counterpart, on the whole given tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract
from bindings.queries import ORACLES, QUERIES
from bindings.views import TABLES
from conftest import SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return repr(value)


def _sorted(rows, order):
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(names)
    ours = _sorted(found.collect(), [found.columns.index(c) for c in sorted(names)])
    theirs = _sorted(expected.fetchall(), [names.index(c) for c in sorted(names)])
    assert ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).columns == ["dstport", "proto", "hits", "port"]
