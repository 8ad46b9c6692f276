"""Every registered query against its SQL; those without SQL must give rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import check, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    ok, message = check(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "score", "snippet"]
