"""Every query of the library against its SQL, over the smallest tables."""

import os

import pytest
from sqlcheck import connect, rows_of_spark, rows_of_sql

from plumbline.queries import FLAGSHIP, ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

#: Beyond SQL; their tests against brute force stand in the other files.
WITHOUT_SQL = {"g14_betweenness", "t12_obfuscation"}


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_all_have_sql_but_those_listed():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES) and FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    assert rows_of_spark(QUERIES[name](spark, SF)) == rows_of_sql(tables, ORACLES[name])


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
