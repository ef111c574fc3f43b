"""Corridors, live candidates, policies, detections, display rows and parity by hand."""

import pytest
from pyspark.sql import functions as F

from trackspark.functions.policy import GapPolicy
from trackspark.functions.projection import frame_of, project
from trackspark.operators import corridor, display, live_pairs, parity, stitch
from trackspark.sources import detections

TRACK = "sequence string, frame int, id int, x double, y double, w double, h double, confidence double, class_id int"


def track(id, frames, x0=0.0, vx=0.0, y=0.0, w=10.0):
    return [("s", f, id, x0 + vx * f, y, w, 10.0, 1.0, 0) for f in frames]


def test_corridor_of_a_track_hidden_behind_a_faster_one(spark):
    rows = track(1, [1, 2, 5], vx=4.0) + track(2, range(1, 6), vx=6.0)
    found = {r.frame: r for r in corridor.corridors(spark.createDataFrame(rows, TRACK)).collect()}
    assert sorted(found) == [3, 4]
    r = found[4]
    assert (r.start_x, r.predicted_x, r.previous_x, r.gap, r.heading, r.major, r.minor) == (13.0, 21.0, 9.0, 2, 0.0, 20.0, 14.7)
    assert (r.model, r.occluder_id, r.side, r.expected_until) == ("paired_motion_corridor", 2, "left", 9)


def test_corridor_of_a_still_track_is_a_circle(spark):
    r = corridor.corridors(spark.createDataFrame(track(1, [1, 3]), TRACK)).first()
    assert (r.model, r.direction, r.side, r.major, r.minor, r.pair_confidence) == ("constant_velocity", "unknown", "unknown", 16.0, 16.0, 0.0)
    assert r.expected_until == 22


@pytest.mark.parametrize(
    ("motion", "want"),
    [((None, 1.0, 1.0, 1.0), "unknown"), ((0.0, 0.0, 1.0, 1.0), "unknown"), ((1.0, 0.0, None, None), "valid"), ((1.0, 0.0, 0.0, 0.0), "unknown"), ((1.0, 0.0, -1.0, 5.0), "inconsistent"), ((1.0, 0.0, 0.0, 5.0), "valid")],
)
def test_direction(spark, motion, want):
    state, _ = corridor.direction(*[F.lit(v).cast("double") for v in motion])
    assert spark.range(1).select(state.alias("s")).first().s == want


def test_continuation_confidence(spark):
    value = lambda *v: spark.range(1).select(corridor.continuation_confidence(*[F.lit(k) for k in v[:4]], 50.0, F.lit(v[4]), 30, F.lit(v[5])).alias("c")).first().c
    assert value(1.0, 1.0, 3, 0.0, 0, 1.0) == pytest.approx(1.0)
    assert value(0.8, 0.0, 1, 25.0, 15, 0.5) == pytest.approx((0.36 + 0.15 + 0.2 / 3 + 0.05) * 0.675 * 0.5)


def test_follow_finds_all_pairs_within_the_gap(spark):
    pieces = [("s", i, 0, s, s + n) for i, (s, n) in enumerate([(1, 5), (7, 3), (8, 2), (17, 1), (28, 0), (39, 4)])]
    df = stitch.follow(spark.createDataFrame(pieces, "sequence string, id int, segment int, frame_start int, frame_end int"), 10)
    want = sorted((a[1], b[1]) for a in pieces for b in pieces if 0 <= b[3] - a[4] - 1 <= 10)
    assert sorted((r.lost_id, r.new_id) for r in df.collect()) == want


def test_live_candidate_uses_the_last_and_first_rows_only(spark):
    rows = track(1, range(1, 21), vx=2.0) + track(2, range(25, 30), vx=2.0) + track(3, range(25, 30), x0=900.0)
    found = {(r.lost_id, r.new_id): r for r in live_pairs.candidates(spark.createDataFrame(rows, TRACK), 1, live_pairs.LiveConfig(head=1, tail=5)).collect()}
    assert sorted(found) == [(1, 2), (1, 3)]
    assert (found[1, 2].reason, found[1, 2].motion_distance, found[1, 2].direct_distance) == ("eligible", 0.0, 10.0)
    assert found[1, 2].score == pytest.approx((1 - 4 / 900 + 3) / 4, abs=1e-6)
    assert found[1, 3].reason == "gate_failed:center_distance"


def test_policies(spark):
    plain, gaps = GapPolicy(winner_margin=0.2, min_appearance=0.5, use_appearance=True, long_gap=3), spark.createDataFrame([(2,), (9,)], "gap int")
    first, second = plain.appearance(F.col("gap"))
    assert [tuple(r) for r in gaps.select(plain.bucket(F.col("gap")), plain.margin(F.col("gap")), first, second).collect()] == [("medium", 0.2, 0.5, True), ("long", 0.2, 0.5, True)]
    split = GapPolicy(short_gap=5, long_gap=8, short_margin=0.01, long_margin=0.3, long_appearance=0.9, use_appearance=True, require_long_appearance=True)
    first, second = split.appearance(F.col("gap"))
    assert [tuple(r) for r in gaps.select(split.bucket(F.col("gap")), split.margin(F.col("gap")), first, second).collect()] == [("short", 0.05, None, False), ("long", 0.3, 0.9, True)]


def test_projection(spark):
    x, y = project(F.lit(1.0), F.lit(2.0), [[1, 0, 1], [0, 1, 1], [0, 0, 0]])
    times = [frame_of(F.lit(t).cast("long"), 25.0, 100).alias(f"t{t}") for t in (0, 100, 139, 140, 1100)]
    assert tuple(spark.range(1).select(x, y, *times).first()) == (None, None, 1, 1, 1, 2, 26)
    with pytest.raises(ValueError, match="matrix"):
        project(F.lit(1.0), F.lit(1.0), [[1, 2], [3, 4]])


def test_detections_are_written_read_and_numbered(spark, tmp_path):
    box = lambda f, x: {"frame_index": f, "x": x, "y": 0.0, "w": 1.0, "h": 1.0, "confidence": 0.5, "class_id": 0}
    rows = [("c", 2, 80, "m", "w", "i", [box(2, 5.0)]), ("c", 1, 40, "m", "w", "i", [box(1, 1.0), box(1, 2.0)]), ("c", 3, 120, "m", "w", "i", []), ("c", 4, 160, "m", "w", "i", None)]
    detections.write(spark.createDataFrame(rows, detections.SCHEMA), str(tmp_path / "d"))
    frames = detections.read(spark, str(tmp_path / "d"), multi_line=False)
    assert sorted((r.frame, r.id, r.x) for r in detections.pseudo_tracks(frames).collect()) == [(1, -3, 2.0), (1, -2, 1.0), (2, -4, 5.0)]
    assert sorted((r.frame_index, r.num_detections) for r in detections.summary(frames).collect()) == [(1, 2), (2, 1), (3, 0), (4, 0)]


def test_events_are_shown_once_around_their_frame(spark):
    hidden = spark.createDataFrame([("s", 1)], "sequence string, id int")
    rows = [("s", 3, 1, 5, 1), ("s", 3, 1, 5, 1), ("s", 9, 2, 6, 2)]
    events = display.recovery_events(hidden, spark.createDataFrame(rows, "sequence string, frame int, lost_id int, new_id int, canonical_id int"))
    assert [r.label for r in events.collect()] == ["ReID recovered raw 5 -> ship 1"]
    assert sorted(r.shown_at for r in display.shown(events, 5, 1).collect()) == [1, 2, 3, 4]


def test_parity(spark):
    a = track(1, [1, 2, 3], vx=1.0)
    one, other = a + [a[1]], a + [a[2]]
    check = lambda x, y: parity.first_difference(spark.createDataFrame(x, TRACK), spark.createDataFrame(y, TRACK)).first()
    assert check(a, a[::-1]).kind is None
    assert check(a, one).kind == "row_count"
    r = check(one, other)
    assert (r.kind, r.place, r.frame) == ("row_content", 2, 2)
