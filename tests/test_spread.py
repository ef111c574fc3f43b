"""Figures of tracks by track first, facts of a track before its hidden rows, and more tasks for larger tables."""

import pytest
from pyspark.sql import functions as F

from trackspark.operators import evaluation, occlusion
from trackspark.plans import observations

ROW = "sequence string, frame int, id int, x double, y double, w double, h double, confidence double, class_id int, visibility double"


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [("st"[f % 2], f // 3 * 2, i, 1.0 * f, 2.0, 3.0, float(i % 4), 1.0 - (i == 3) / 2, 0, 1.0 + (f == 7)) for f in range(60) for i in range(6) if (f * i) % 5 < 3]
    return spark.createDataFrame([*rows, ("s", 4, None, 1.0, 1.0, 1.0, 1.0, 1.0, 0, 1.0)], ROW)


def test_validate_counts_as_distinct_counts_do(tracks):
    want = tracks.groupBy("sequence").agg(F.count("*"), F.countDistinct("id"), F.count("*") - F.countDistinct("frame", "id"), F.min("frame"), F.max("frame")).collect()
    found = evaluation.validate(tracks).select("sequence", "num_rows", "num_ids", "duplicates", "min_frame", "max_frame").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and any(r.duplicates for r in found)
    assert "Expand" not in evaluation.validate(tracks)._jdf.queryExecution().toString()


def test_hidden_rows_are_not_joined(tracks):
    gone = occlusion.gap_predictions(tracks).select("sequence", "id", "frame")
    want = sorted(map(repr, occlusion.returned(gone, occlusion.reappearances(tracks)).collect()))
    found = occlusion.hidden_returns(tracks)
    assert want and sorted(map(repr, found.collect())) == want
    assert "Join" not in found._jdf.queryExecution().toString()


def test_recoveries_are_those_of_joined_rows(spark, tracks):
    gone, back = occlusion.gap_predictions(tracks).select("sequence", "id", "frame", "gap"), occlusion.reappearances(tracks)
    names = spark.createDataFrame([("s", 1, 1), ("s", 2, 1), ("t", 3, 3)], "sequence string, raw_id int, canonical_id int")
    decided = spark.createDataFrame([("s", 2, 1, 9, "accepted"), ("s", 3, 1, 12, "accepted"), ("t", 4, 5, 9, "accepted"), ("t", 2, 3, 9, "eligible")], "sequence string, new_id int, lost_id int, decision_frame int, reason string")
    want = sorted(map(repr, occlusion.recovered(gone, back, names, decided).collect()))
    assert want and sorted(map(repr, occlusion.hidden_recoveries(tracks, names, decided).collect())) == want


def test_more_rows_are_dealt_over_more_tasks(spark, tracks, monkeypatch):
    monkeypatch.setattr(observations, "ROWS", 10)
    assert observations.spread(tracks, 200, "sequence", "id").rdd.getNumPartitions() == 20
    assert observations.spread(tracks, 50, "sequence", "id") is tracks
