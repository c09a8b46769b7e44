"""The corpus queries that SQL can say, on the driver's smallest tables."""

import os

import pytest
from sqlcheck import connect, same

from loomline import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert same(llm.queries()[name](spark, SF), connect(SF), llm.oracle_sql()[name]) > 0
