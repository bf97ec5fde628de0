"""Text queries that SQL can express, against DuckDB."""

import pytest
from same_rows import connect, rows

from kinfold.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), connect(sf).sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
