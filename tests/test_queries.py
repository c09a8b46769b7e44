"""Every query of the panel library at the smallest scale, against its SQL where it has some."""

import os

import pytest
from sqlcheck import connect, same

from loomline import plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.queries(), plans.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
