"""Transponder sources, scores and assignments by hand."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackspark.operators import transponder
from trackspark.sources import ais


def written(folder, sync, positions):
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"version": 1, "sync": sync, "positions": positions}))
    return str(folder)


def at(mmsi, **rest):
    return {"mmsi": mmsi, "latitude_deg": 1.0, "longitude_deg": 2.0, **rest}


def test_sidecar_frames(spark, tmp_path):
    by_index = written(tmp_path / "i", {"mode": "frame_index"}, [at(1, frame=1), at(2, frame=1), at(1, frame=3)])
    assert sorted(r.frame for r in ais.sidecars(spark, by_index).collect()) == [1, 1, 3]
    timed = written(tmp_path / "t", {"mode": "timestamp_ms", "time_offset_ms": 0}, [at(1, timestamp_ms=0), at(1, timestamp_ms=1000)])
    assert sorted(r.frame for r in ais.sidecars(spark, timed, video_fps=30).collect()) == [1, 31]
    assert [r.frame for r in ais.sidecars(spark, timed, video_fps=30, offset_ms=1000).collect()] == [1, 1]
    with pytest.raises(PySparkException, match="video_fps"):
        ais.sidecars(spark, timed).collect()
    with pytest.raises(PySparkException, match="below 1"):
        ais.sidecars(spark, written(tmp_path / "z", {}, [at(1, frame=0)])).collect()
    assert ais.sidecars(spark, written(tmp_path / "e", {}, [])).count() == 0


def test_fixes_of_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("mmsi,timestamp_ms,pixel_x,pixel_y\n7,0,1,2\n7,1000,,4\n")
    rows = ais.fixes_csv(spark, str(tmp_path / "f.csv")).orderBy("timestamp_ms").collect()
    assert [(r.mmsi, r.timestamp_ms, r.pixel_x, r.has_pixel) for r in rows] == [("7", 0.0, 1.0, True), ("7", 1000.0, None, False)]


TRACKS = "sequence string, id int, frame int, x double, y double, w double, h double"
STATES = "sequence string, frame int, mmsi string, x double, y double, angle double"


def test_two_vessels_find_their_own_transponders(spark):
    tracks = [("a", 1, f, 95.0 + 10 * (f - 1), 45.0, 10.0, 10.0) for f in range(1, 6)] + [("a", 2, f, 95.0 - 10 * (f - 1), 75.0, 10.0, 10.0) for f in range(1, 6)]
    states = [("a", f, "111", 100.0 + 10 * (f - 1), 50.0, 0.0) for f in range(1, 6)] + [("a", f, "222", 100.0 - 10 * (f - 1), 80.0, 180.0) for f in range(1, 6)]
    found = transponder.assign_by_scores(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(states, STATES)).orderBy("id").collect()
    assert [(r.id, r.mmsi, r.score, r.overlap) for r in found] == [(1, "111", 1.0, 5), (2, "222", 1.0, 5)]


def test_what_cannot_be_said_is_neutral(spark):
    tracks = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 10.0, 10.0), ("b", 1, 1, 0.0, 0.0, 10.0, 10.0)], TRACKS)
    late = spark.createDataFrame([("a", 9, "5", 5.0, 5.0, 0.0)], STATES)
    found = {r.sequence: r for r in transponder.assign_by_scores(tracks, late).collect()}
    assert (found["a"].reason, found["a"].score, found["a"].mmsi) == ("no_temporal_overlap", 0.5, None)
    assert (found["b"].reason, found["b"].position, found["b"].overlap) == ("no_ais_coverage", 0.5, 0)
    bare = spark.createDataFrame([("a", 1, "5", None, None, None)], STATES)
    pair = transponder.pair_scores(tracks, bare).first()
    assert (pair.position, pair.heading, pair.speed, pair.score) == (0.5, 0.5, 0.5, 0.425)
    assert pair.reason == "ais_pixel_position_unavailable;ais_heading_unavailable"


def test_nearest_fix_and_identity_pairs(spark):
    pieces = spark.createDataFrame([("a", 3, 2, 47.0, 43.0, 10.0, 10.0), ("a", 4, 2, 500.0, 43.0, 10.0, 10.0)], TRACKS).withColumn("segment", F.lit(0))
    fixes = spark.createDataFrame([("a", 2, "99", 50.0, 50.0, None), ("a", 2, "98", 90.0, 50.0, None)], STATES)
    assert {r.id: r.mmsi for r in transponder.nearest_fix(pieces, fixes, 50).collect()} == {3: "99", 4: None}
    pairs = spark.createDataFrame([("1", "1"), ("1", "2"), (None, "2")], "a string, b string")
    said = pairs.select(*[c.alias(k) for c, k in zip(transponder.identity_pair(F.col("a"), F.col("b"), hard=True), ("score", "gate", "note"), strict=True)]).collect()
    assert [tuple(r) for r in said] == [(1.0, True, "mmsi_match"), (0.0, False, "mmsi_hard_mismatch"), (0.5, True, "ais_missing")]


def test_support_of_remaps(spark):
    remaps = spark.createDataFrame([("a", "6->2"), ("a", " 7 -> 3"), ("a", "8->2"), ("a", "9->"), ("a", "none"), ("a", None)], "sequence string, remap string")
    raw = spark.createDataFrame([("a", 6, "11"), ("a", 7, "12"), ("a", 8, "")], "sequence string, id int, mmsi string")
    canonical = spark.createDataFrame([("a", 2, "11"), ("a", 3, "13")], "sequence string, id int, mmsi string")
    said = {r.source: (r.target, r.verdict) for r in transponder.remap_support(remaps, raw, canonical).collect()}
    assert said == {6: (2, "supported"), 7: (3, "penalized"), 8: (2, "unavailable")}
