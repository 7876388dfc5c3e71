"""Queries that have SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle
from tessera.llm import registry


@pytest.fixture(scope="module")
def db(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, sf, db, name):
    oracle.assert_same(registry.QUERIES[name](spark, sf), db, registry.SQL[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
