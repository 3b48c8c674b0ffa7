from __future__ import annotations

import pytest

from tests.oracle import both
from textloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    found, expected = both(spark, QUERIES[name], ORACLE_SQL[name])
    assert found == expected
