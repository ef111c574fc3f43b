"""The margin over the runner-up needs the two best pairs of a tracklet, not all."""

from trackspark import queries


def test_only_the_two_best_are_exchanged(spark):
    plan = queries.QUERIES["stitch_top2_margin"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan[plan.index("WindowGroupLimit") :]
