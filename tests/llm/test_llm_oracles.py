"""Queries of the subpackage on the smallest tables against their SQL."""

import pytest
from compare import differences

from trackspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)
