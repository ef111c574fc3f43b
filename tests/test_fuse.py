"""Global ids of two cameras against the frame-by-frame rule."""

import random

import pytest

from trackspark import queries
from trackspark.operators import cameras

SCHEMA = "sequence string, frame int, id int, x double, y double, w double, h double"


def by_frames(a, b, pairs):
    """Rows (sequence, frame, camera, id, partner, global id); pairs (sequence, frame, a, b, distance)."""
    out = set()
    for sequence in {r[0] for r in a + b}:
        known, new = {}, 1
        for frame in sorted({r[1] for r in a + b if r[0] == sequence}):
            here = sorted((p[4], p[2], p[3]) for p in pairs if p[:2] == (sequence, frame))
            for _, i, j in here:
                found = known.get(("a", i), known.get(("b", j)))
                if found is None:
                    found, new = new, new + 1
                known["a", i] = known["b", j] = found
            partner = {("a", i): j for _, i, j in here} | {("b", j): i for _, i, j in here}
            for key in [(n, k) for n, rows in (("a", a), ("b", b)) for k in sorted(r[2] for r in rows if r[:2] == (sequence, frame))]:
                if key not in known:
                    known[key], new = new, new + 1
                out.add((sequence, frame, *key, partner.get(key), known[key]))
    return out


def check(spark, a, b):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    pairs = cameras.greedy_pairs(cameras.near_pairs(left, right))
    found = [tuple(r) for r in cameras.fuse(left, right, pairs).collect()]
    want = by_frames(a, b, [tuple(r) for r in pairs.select("sequence", "frame", "a_id", "b_id", "distance").collect()])
    assert len(found) == len(a) + len(b) and set(found) == want


def test_random_boxes(spark):
    dice = random.Random(1)
    box = lambda s, f, k: (s, f, k, dice.choice([0.0, 150.0, 400.0, 1500.0]), dice.choice([0.0, 90.0, 700.0]), 10.0, 10.0)
    sides = [[box(s, f, k) for s in "pq" for f in range(30) for k in range(1, 13) if dice.random() < 0.25] for _ in "ab"]
    check(spark, *sides)


def test_long_chain_and_empty_sides(spark):
    # other box 1 meets a new reference box in each frame: all have the first one's id
    at = lambda f, k: ("p", f, k, 5.0, 5.0, 10.0, 10.0)
    check(spark, [at(f, f + 1) for f in range(1, 20)], [at(f, 1) for f in range(25)])
    check(spark, [at(f, f + 1) for f in range(3)], [("q", 1, 1, 0.0, 0.0, 1.0, 1.0)])


def test_query_keeps_every_box(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.QUERIES["fuse_cameras"](spark, sf)
    boxes = queries.observations(spark, sf).count() + queries.predictions(spark, sf).count()
    assert df.count() == boxes and df.where("global_id is null").isEmpty() and df.where("partner_id is null").count()


def test_modes_of_pairing(spark):
    box = "sequence string, frame int, id int, x double, y double, w double, h double"
    dice = random.Random(12)
    rows = lambda: [("s", f, i, dice.uniform(0, 1900), dice.uniform(0, 1000), 10.0, 10.0) for f in range(40) for i in dice.sample(range(6), dice.randrange(4))]
    left, right = rows(), rows()
    a, b = (spark.createDataFrame(r, box) for r in (left, right))
    for mode in ("auto", "rank_x", "normalized_center"):
        want = set()
        for f in range(40):
            mine, other = ([r for r in side if r[1] == f] for side in (left, right))
            if mode != "normalized_center" and len(mine) == len(other):
                by_x = lambda r: (r[3], r[2])
                want |= {(f, m[2], o[2]) for m, o in zip(sorted(mine, key=by_x), sorted(other, key=by_x))}
                continue
            near = sorted((round((((m[3] - o[3]) / 1920) ** 2 + ((m[4] - o[4]) / 1080) ** 2) ** 0.5, 6), m[2], o[2]) for m in mine for o in other)
            used_m, used_o = set(), set()
            for d, m, o in near:
                if d <= 0.55 and m not in used_m and o not in used_o:
                    want.add((f, m, o))
                    used_m.add(m)
                    used_o.add(o)
        assert {(r.frame, r.a_id, r.b_id) for r in cameras.paired(a, b, mode).collect()} == want, mode
    fused = cameras.fuse_tracks(a, b)
    assert fused.count() == len(left) + len(right) and fused.where("global_id is null").isEmpty()
    with pytest.raises(ValueError):
        cameras.paired(a, b, "nearest")
