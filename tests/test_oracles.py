"""Every query of the core that has SQL gives the rows of that SQL; the others run."""

import pytest

from palimpsest.queries import core
from tests import oracle


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connection(folder)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_rows_as_sql(spark, folder, con, name):
    assert oracle.rows_of_spark(core.QUERIES[name](spark, folder)) == oracle.rows_of_sql(con, core.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_runs(spark, folder, name):
    df = core.QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows and len(df.columns) == len(rows[0])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["query_id", "uid", "score", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
