"""The queries that SQL can state, against DuckDB."""

import pytest

from checks.compare import compare, duck
from rowguard.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, folder, name):
    ok, note = compare(spark, duck(folder), folder, name, QUERIES[name], ORACLES[name])
    assert ok, note
