"""Every registered query of the core against its SQL on the smallest tables."""

import oracle
import pytest
from tessera import queries


@pytest.fixture(scope="module")
def db(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    oracle.assert_same(queries.QUERIES[name](spark, sf), db, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - {"layout_jobs"}))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "job_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
