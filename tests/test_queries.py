"""Every registered query of the package's own operators gives the rows of its SQL."""

import pytest

from chalkline.plans import queries, review_queries, review_sql, sql
from tests.compare import duck_rows, spark_rows

QUERIES = queries.QUERIES | review_queries.QUERIES
ORACLE_SQL = sql.ORACLE_SQL | review_sql.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns, rows = duck_rows(duck, ORACLE_SQL[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == rows


def test_entry_imports_and_lists():
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
