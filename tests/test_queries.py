"""Every registered query against its SQL, exact after rounding."""

from __future__ import annotations

import pytest

from verification.check import difference, duckdb_views
from verification.oracle import SQL
from verification.queries import QUERIES

#: queries without SQL, and why
NO_SQL: dict[str, str] = {
    "nystrom_halving_rbf": "elimination of thousands of landmarks; brute force in test_tiles",
    "nystrom_refine_rbf": "the same",
}


@pytest.fixture(scope="module")
def connection(sf):
    return duckdb_views(sf)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) == set(SQL) | set(NO_SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, connection, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert difference(got, connection.sql(SQL[name]).df()) == ""
    assert len(got)
