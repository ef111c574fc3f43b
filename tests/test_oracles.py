"""Every query on the smallest tables against its SQL."""

import pytest
from compare import differences

from trackspark import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert not differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
