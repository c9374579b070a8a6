"""Training-text queries against DuckDB on the smallest test tables."""

import os

import pytest

from assize.llm import catalog
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    oracle.check(spark, con, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, oracle.DATA)
    rows = df.collect()
    assert rows and len(df.columns) == len(set(df.columns)) and all(len(r) == len(df.columns) for r in rows)
