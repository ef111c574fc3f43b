"""Rows of pairs go through generated methods that the JVM compiles, and are neither made twice nor written in between."""

import pytest

from trackspark import queries

#: HotSpot leaves longer methods to its interpreter.
LONGEST = 8000


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["motion_priors", "motion_consistency", "classify_encounter"])
def test_no_method_is_too_long_to_compile(spark, whole_plans, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(plan)
    sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    assert sizes and max(sizes) <= LONGEST, sizes
    assert "Union" not in plan.toString()
