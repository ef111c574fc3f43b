"""The ledger reads the leading candidates of a decision, and more only where these do not suffice."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_ledger import ROW, SMALL, some_tracks

from trackspark.functions.scores import round_six
from trackspark.operators import ledger


@pytest.fixture(scope="module")
def sides(spark):
    seen = ledger.sightings(spark.createDataFrame(some_tracks(5, "p", 60, 12), ROW)).localCheckpoint()
    return ledger.decisions_due(seen, SMALL).localCheckpoint(), ledger.lost_runs(seen, SMALL).localCheckpoint()


@pytest.mark.parametrize("ties", [False, True])
def test_few_leading_candidates_give_the_choices_of_all(spark, sides, monkeypatch, ties):
    config = replace(SMALL, tie_break_margin=0.05) if ties else SMALL
    pairs = ledger.eligible_pairs(*sides, config).withColumn("bonus", F.when(F.col("lost_id") % 3 == 0, 0.01).otherwise(0.0)).localCheckpoint()
    found = []
    for leading in (1, 10000):
        monkeypatch.setattr(ledger, "LEADING", leading)
        found.append(sorted(map(repr, ledger.ledger(pairs, config).collect())))
    assert found[0] == found[1] and any("outscored_by" in r for r in found[0])


def test_candidates_behind_are_counted_and_not_exchanged(sides):
    pairs = ledger.eligible_pairs(*sides, SMALL).localCheckpoint()
    rows = ledger._leading(pairs, [ledger.by_score()], 2).collect()
    counts = {(r.sequence, r.new_id): r["count"] for r in pairs.groupBy("sequence", "new_id").count().collect()}
    assert max(counts.values()) > 2
    assert {(r.sequence, r.new_id): r.of for r in rows} == counts and len(rows) == sum(min(2, n) for n in counts.values())


def test_rounding_is_that_of_decimals(spark):
    values = [0.1234565, -0.1234565, 2.5e-6, -1e-9, -0.0, 1e7 + 0.0000005, 123456.7890125, 1e300, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values] + [((k - 500) * 5e-7,) for k in range(1000)], "v double")
    assert not df.where(~F.round("v", 6).eqNullSafe(round_six(F.col("v")))).count()
    assert str(df.select(round_six(F.lit(-1e-9))).first()[0]) == "0.0"
