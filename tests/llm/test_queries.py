"""Text preparation queries with SQL give its rows; the others run."""

import pytest

from palimpsest.llm import queries, sql
from tests import oracle


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_rows_as_sql(spark, folder, name):
    assert oracle.rows_of_spark(queries.QUERIES[name](spark, folder)) == oracle.rows_of_sql(oracle.connection(folder), sql.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.ORACLES)))
def test_runs(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert df.columns and len(df.collect()) >= (name != "p9_found")  # the smallest tables have few labels
