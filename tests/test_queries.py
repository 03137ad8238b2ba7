"""Every registered query with SQL against DuckDB, the others for rows and schema, on the smallest tables."""

from __future__ import annotations

import pytest

from brindle.plans import registry
from tests.conftest import DATA
from tests.oracle import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, DATA, name, QUERIES[name], SQL.get(name)) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
