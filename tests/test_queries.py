from __future__ import annotations

import pytest

from tests.oracle import SF, both
from textloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    found, expected = both(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert found[0] == expected[0]
    assert found[1] == expected[1]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_other_queries_run_over_their_tables(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
