"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL.get(name), SF) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["l_returnflag", "l_linestatus"] and df.count() > 0
