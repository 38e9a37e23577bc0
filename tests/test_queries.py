"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import pytest

import oracle
import __spark_entry__ as entry
from shelfmark import catalogue

FOLDER = "/root/testdata/sf0.001"
# At this scale no order, worker or seed makes these results non-empty.
MAY_BE_EMPTY: set[str] = {"links_capped", "discovery_capped", "status_available"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    assert sql is not None
    problem = oracle.compare(spark, con, FOLDER, entry.queries()[name], sql)
    if name in MAY_BE_EMPTY and problem == "empty result":
        return
    assert problem is None, problem


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50
    assert rows == sorted(rows, key=lambda r: r["url"])
    assert all(r["name"] and len(r["name"]) <= 80 for r in rows)
