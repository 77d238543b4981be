"""The operators' queries that have SQL give its rows."""

import pytest

from chalkline.llm.queries import QUERIES
from chalkline.llm.sql import ORACLE_SQL
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns, rows = duck_rows(duck, ORACLE_SQL[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == rows
