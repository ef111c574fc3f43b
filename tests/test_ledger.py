"""Live re-identification: the relational batch form against the frame-by-frame mapper, gates by hand, and a stream of micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from trackspark.functions.policy import GapPolicy
from trackspark.operators import ledger
from trackspark.operators.components import components
from trackspark.operators.ledger import Candidate, LedgerConfig, Merges, choose
from trackspark.operators.live_pairs import LiveConfig
from trackspark.streaming import live

ROW = "sequence string, frame int, id int, x double, y double, w double, h double, class_id int"
SMALL = LedgerConfig(pairs=LiveConfig(max_frame_gap=12, max_center_distance=40.0, base_region_radius=20.0), confirm=3, memory=9, min_score=0.4, policy=GapPolicy(min_margin=0.02), short_gap=2, short_gap_score=0.7, short_gap_margin=0.05, recent_merge=15, chain_bonus=0.05, chained_bonus=0.03)


def some_tracks(seed, sequences="pq", frames=90, ids=14):
    """Boats that come and go under several ids each; frames without rows, ids that return, and ids of 0 and less."""
    dice, rows = random.Random(seed), []
    for s in sequences:
        for boat in range(ids):
            x, y, w, h, kind = dice.uniform(0, 200), dice.uniform(0, 200), dice.uniform(20, 40), dice.uniform(10, 20), dice.randrange(2)
            own = [boat + 1, boat + 101, boat + 201, boat + 301]
            frame = dice.randrange(20)
            while frame < frames:
                name = dice.choice(own)
                for _ in range(dice.choice([1, 2, 3, 6, 10])):
                    if frame % 13:
                        rows.append((s, frame, name, round(x + dice.uniform(-3, 3), 2), round(y + dice.uniform(-3, 3), 2), round(w + dice.uniform(-2, 2), 2), round(h, 2), kind))
                    frame += 1
                    x, y = x + dice.uniform(0, 2), y + dice.uniform(0, 2)
                frame += dice.choice([1, 2, 5, 14])
    return list({r[:3]: r for r in rows}.values())


def mapped(rows, config):
    out = []
    for s in {r[0] for r in rows}:
        mapper, frames = live.LiveMapper(config), sorted({r[1] for r in rows if r[0] == s})
        for f in frames:
            out += [(s, *o) for o in mapper.update(f, [r[2:] for r in rows if r[0] == s and r[1] == f and r[2] is not None])]
        out += [(s, *o) for o in mapper.flush(frames[-1])]
    return out


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_batch_gives_the_rows_of_the_mapper(spark, small_batches):
    kinds = set()
    for seed in (1, 2, 3):
        rows = some_tracks(seed)
        tracks = spark.createDataFrame(rows, ROW).repartition(3)
        found, decided = ledger.live_identities(tracks, SMALL)
        want = mapped(rows, SMALL)
        got = ledger.remapped(tracks, found).select("sequence", "frame", "raw_id", "id", "x", "y", "w", "h", "class_id").collect()
        assert sorted(map(tuple, got)) == sorted(r[:-1] for r in want)
        settled = {(r[0], r[2]): r[-1] for r in sorted(want, key=lambda r: -r[1])}
        assert {(r.sequence, r.raw_id): r.decision_frame for r in found.collect()} == settled
        kinds |= {r.reason.split(":")[0] for r in decided.collect()}
        total = ledger.summary(found, decided).collect()
        assert sum(r.accepted for r in total) == sum(r.reason == "accepted" for r in found.collect()) == sum(len(r.remaps) for r in total)
    assert kinds >= {"accepted", "outscored_by", "below_score_threshold", "margin_too_small", "short_gap_gate_score", "eligible"} and any(k.startswith("chain_control") for k in kinds)


def test_ids_of_zero_and_less_get_numbers_above_all_others(spark):
    rows = [("s", f, i, 100.0 * abs(i), 50.0, 10.0, 10.0, 0) for f in range(4) for i in (0, -5, 7)]
    found, _ = ledger.live_identities(spark.createDataFrame(rows, ROW), SMALL)
    assert {r.raw_id: r.canonical_id for r in found.collect()} == {-5: 8, 0: 9, 7: 7}


def test_frames_without_boxes_count_if_a_row_says_so(spark):
    rows = [("s", 1, 1, 0.0, 0.0, 10.0, 10.0, 0), ("s", 9, 2, 900.0, 0.0, 10.0, 10.0, 0)]
    ticks = [("s", f, None, None, None, None, None, None) for f in range(1, 12)]
    for more, want in (([], {1: 9, 2: 9}), (ticks, {1: 2, 2: 10})):
        found, _ = ledger.live_identities(spark.createDataFrame(rows + more, ROW), SMALL)
        assert {r.raw_id: r.decision_frame for r in found.collect()} == want
        assert {r[2]: r[-1] for r in mapped(rows + more, SMALL)} == want


def test_gates_by_hand():
    config, whole = LedgerConfig(), lambda i: {7: 3}.get(i, i)
    cases = [
        ([Candidate(1, (), 50, 0.54, 1.0)], Merges(), "below_score_threshold:0.540<0.550"),
        ([Candidate(1, (), 50, 0.70, 1.0), Candidate(2, (), 50, 0.66, 1.0)], Merges(), "margin_too_small:0.040<0.050"),
        ([Candidate(1, (), 3, 0.79, 1.0)], Merges(), "short_gap_gate_score:0.790<0.800"),
        ([Candidate(1, (), 3, 0.90, 1.0), Candidate(2, (), 50, 0.80, 1.0)], Merges(), "short_gap_gate_margin:0.100<0.120"),
        ([Candidate(1, (), 6, 0.79, 1.0)], Merges(), "accepted"),
        ([Candidate(1, (), 3, 0.60, 1.0)], Merges(1, 900), "chain_control_score:0.600<0.670"),  # its own id, soon after a merge
        ([Candidate(1, (), 3, 0.60, 1.0)], Merges(1, 819), "accepted"),  # 181 frames later
        ([Candidate(7, (), 3, 0.74, 1.0)], Merges(1, 1), "chain_control_score:0.740<0.750"),  # a chained id
        ([Candidate(7, (), 3, 0.79, 1.0)], Merges(2, 1), "chain_control_score:0.790<0.800"),
        ([Candidate(7, (), 3, 0.90, 1.0), Candidate(2, (), 3, 0.81, 1.0)], Merges(1, 1), "chain_control_margin:0.090<0.100"),
        ([Candidate(7, (), 3, 0.90, 1.0), Candidate(2, (), 3, 0.80, 1.0)], Merges(1, 1), "accepted"),
    ]
    for candidates, record, want in cases:
        before = record.absorbed
        best = choose(candidates, whole, 1000, 9, lambda _: record, config)
        assert candidates[0].reason == want
        assert (best is not None) == (want == "accepted") and record.absorbed == before + (best is not None)
        if best is not None:
            assert all(c.reason == f"outscored_by:9->{best.id}" for c in candidates[1:]) and record.last == 1000
    assert choose([], whole, 1, 9, lambda _: Merges(), config) is None
    policy = GapPolicy(winner_margin=0.06, short_gap=10, long_gap=40, short_margin=0.03, long_margin=0.1)
    assert [policy.margin_at(g) for g in (10, 11, 41)] == [0.05, 0.06, 0.1]


def test_components_of_paths_stars_and_nothing(spark):
    links = [("a", i, i + 1) for i in range(50)] + [("a", 100, 200 + i) for i in range(30)] + [("b", 3, 1), ("b", 1, 3), ("b", 5, 5), ("b", None, 4)]
    found = {(r.sequence, r.id): r.component for r in components(spark.createDataFrame(links, "sequence string, a int, b int")).collect()}
    assert found == {("a", i): 0 for i in range(51)} | {("a", i): 100 for i in [100, *range(200, 230)]} | {("b", 1): 1, ("b", 3): 1}
    assert components(spark.createDataFrame([], "sequence string, a int, b int")).count() == 0


def test_stream_gives_the_rows_of_the_batch_and_leaves_no_state(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = some_tracks(4, sequences="pqr", frames=40)
    at = lambda f: f"2024-01-01 00:{f // 60:02d}:{f % 60:02d}"
    dice = random.Random(1)
    timed = sorted(((*r, at(r[1])) for r in rows), key=lambda r: r[1] + dice.uniform(0, 4))  # out of order by less than the delay
    cut = [0, len(timed) // 3, 2 * len(timed) // 3, len(timed)]
    batches = [timed[a:b] for a, b in zip(cut, cut[1:])] + [[("end", 1, None, None, None, None, None, None, "2024-01-01 02:00:00")], [("end", 2, None, None, None, None, None, None, "2024-01-01 03:00:00")]]
    late = [("p", 2, 1, 0.0, 0.0, 1.0, 1.0, 0, at(2))]  # long after its frame
    batches[2] = batches[2] + late
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = ROW + ", ts timestamp"
    frames = [spark.createDataFrame(b, ROW + ", ts string").withColumn("ts", F.to_timestamp("ts")) for b in batches]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = live.live_stream(spark.readStream.schema(schema).parquet(f"{source}/*"), SMALL, delay="6 seconds", idle_seconds=30)
    run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for i, frame in enumerate(frames):
            frame.coalesce(1).write.parquet(f"{source}/{i}")
            run.processAllAvailable()
        left = run.lastProgress["stateOperators"][0]
    finally:
        run.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = [r for r in mapped(rows, SMALL)]
    got = [tuple(r) for r in spark.read.parquet(sink).select("sequence", "frame", "raw_id", "id", "x", "y", "w", "h", "class_id", "decision_frame").collect()]
    assert sorted(got) == sorted(want)
    assert left["numRowsTotal"] <= 8, left  # what waits of the sequence "end"
    assert {(r.raw_id, r.canonical_id) for r in live.mapping(spark.read.parquet(sink).where("sequence = 'q'")).collect()} == {(r[2], r[3]) for r in want if r[0] == "q"}
