"""Queries of the training-data operators against their SQL, and which have none."""

import pytest

from checks.compare import compare, database
from stationflow.llm import queries
from tests.llm.conftest import FOLDER

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_sql_is_of_known_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert not compare(con, QUERIES[name](spark, FOLDER), SQL[name])
