"""Every named query against its SQL, over the whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from bazaarflow.plans.catalog import ORACLE, QUERIES
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert {**contract.queries()}.keys() >= QUERIES.keys() and contract.oracle_sql().keys() >= ORACLE.keys()


def test_entry(spark):
    rows = {r["label"]: r for r in contract.entry(spark).collect()}
    assert len(rows) == 4 and rows["Total Revenue"]["value"].startswith("₹")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, folder, name):
    df = contract.queries()[name](spark, folder)
    assert difference(df, contract.oracle_sql()[name], connection) is None
