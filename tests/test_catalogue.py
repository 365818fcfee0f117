"""Every catalogue query with SQL gives the same rows as DuckDB; the others run."""

import pytest

from lodestone import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_as_sql(name, same):
    same(q.QUERIES[name], q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(name, spark):
    df = q.QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) > 0
    assert set(e.oracle_sql()) <= set(e.queries())
