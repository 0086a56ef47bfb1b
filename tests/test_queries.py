"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import pytest
from oracle import compare, connect

from sqlbranch.plans import dialect, frames, registry, services, workspaces  # noqa: F401


@pytest.fixture(scope="module")
def database(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, database, name):
    assert compare(spark, database, registry.queries()[name], registry.oracle_sql()[name], sf) == ""


def test_each_query_has_an_oracle():
    assert registry.queries().keys() == registry.oracle_sql().keys()
