"""Documents that hold what operators must bear: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import pytest
from messy import REST, ROWS, SCHEMA


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([r + (len(r[1] or ""),) + REST for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
