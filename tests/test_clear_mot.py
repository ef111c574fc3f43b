"""Tracking metrics against brute force and hand-made sequences."""

import itertools
import random

from trackspark.operators import clear_mot

BOX = "sequence string, frame int, id int, x double, y double, w double, h double, class_id int"


def cheapest(costs, below=None):
    """Best total over all one-to-one choices: (most pairs, least cost), or least cost alone."""
    left, right = sorted({a for a, _ in costs}), sorted({b for _, b in costs})
    found = [(0, 0.0)]
    for n in range(1, min(len(left), len(right)) + 1):
        for some in itertools.combinations(left, n):
            for order in itertools.permutations(right, n):
                pairs = list(zip(some, order))
                if all(p in costs for p in pairs):
                    found.append((-n, sum(costs[p] for p in pairs)))
    return min(c for _, c in found) if below is not None else min(found)


def test_cheapest_pairs():
    dice = random.Random(4)
    for _ in range(300):
        costs = {(a, f"r{b}"): round(dice.uniform(-1, 1), 3) for a in range(4) for b in range(4) if dice.random() < 0.5}
        pairs = clear_mot.cheapest_pairs(costs)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        want = cheapest(costs)
        assert len(pairs) == -want[0] and abs(sum(costs[p] for p in pairs) - want[1]) < 1e-9
        pairs = clear_mot.cheapest_pairs(costs, below=0.0)
        assert abs(sum(costs[p] for p in pairs) - cheapest(costs, 0.0)) < 1e-9


def test_cheapest_pairs_of_ties():
    dice = random.Random(6)
    hard = {(0, 0): -2, (0, 2): -3, (1, 0): -2, (1, 1): -1, (1, 2): -3, (2, 0): -2, (2, 1): -1, (2, 2): -3}
    for k in range(1000):
        costs = {(a, b): float(dice.choice([0, -1, -2, -3] if k % 2 else [0, 0.5, 1])) for a in range(dice.randrange(1, 5)) for b in range(4) if dice.random() < 0.7} if k else hard
        if not costs:
            continue
        pairs = clear_mot.cheapest_pairs(costs)
        want = cheapest(costs)
        assert (-len(pairs), sum(costs[p] for p in pairs)) == want
        assert sum(costs[p] for p in clear_mot.cheapest_pairs(costs, below=0.0)) == cheapest(costs, 0.0)


def test_contested_frames_by_a_loop_and_identities_by_hand(spark):
    dice = random.Random(7)
    rows = sorted({(s, f, a, b): round(dice.uniform(0, 0.5), 1) for s in "pq" for f in range(50) for a in range(6) for b in range(6) if dice.random() < (0.35 if a < 3 else 0.03)}.items())
    near = spark.createDataFrame([(*k, d) for k, d in rows], "sequence string, frame int, gt_id int, pred_id int, distance double").repartition(3)
    want = {}
    for s in "pq":
        last = {}
        for f in range(50):
            costs = {k[2:]: d for k, d in rows if k[:2] == (s, f)}
            kept = {}
            for a, b in sorted(costs):
                if last.get(a) == b and b not in kept.values():
                    kept[a] = b
            rest = cheapest({(a, b): d for (a, b), d in costs.items() if a not in kept and b not in kept.values()})
            want[s, f] = kept, rest, costs
            found = clear_mot.cheapest_pairs({(a, b): d for (a, b), d in costs.items() if a not in kept and b not in kept.values()})
            last |= kept | dict(found)
    got = {}
    for r in clear_mot.frame_matches(near).collect():
        got.setdefault((r.sequence, r.frame), {})[r.gt_id] = r.pred_id
    for key, (kept, rest, costs) in want.items():
        pairs = got.get(key, {})
        assert kept.items() <= pairs.items() and len(set(pairs.values())) == len(pairs)
        assert len(pairs) - len(kept) == -rest[0] and abs(sum(costs[p] for p in pairs.items() if p[0] not in kept) - rest[1]) < 1e-9
    counts = [("s", 1, 7, 5), ("s", 1, 8, 4), ("s", 2, 7, 4), ("s", 3, 9, 2)]  # 1-8 and 2-7 are 8 boxes, 1-7 alone 5
    boxes = spark.createDataFrame([(s, f, a, b, 0.0) for s, a, b, n in counts for f in range(n)], near.schema)
    assert clear_mot.identity_hits(boxes).first().idtp == 10


def test_switch_miss_false_positive_and_fragment(spark):
    at = lambda f, i, x, c=0: ("s", f, i, x, 0.0, 10.0, 10.0, c)
    truth = [at(f, 1, 0.0) for f in range(1, 7)] + [at(f, 2, 100.0) for f in range(1, 7)]
    seen = [at(1, 7, 0.0), at(2, 7, 1.0), at(4, 8, 0.0), at(5, 8, 0.0), at(6, 8, 0.0)]  # 1: found as 7, missed, then as 8
    seen += [at(f, 9, 100.0, int(f == 3)) for f in range(1, 7)] + [at(1, 10, 500.0)]  # 2: another class in frame 3
    # a second box on track 1 in frame 2 is nearer, but the partner before stays
    seen += [at(2, 11, 0.0)]
    df = clear_mot.metrics(spark.createDataFrame(truth, BOX), spark.createDataFrame(seen, BOX))
    r = df.where("sequence = 's'").first()
    assert (r.num_frames, r.num_objects, r.num_predictions, r.matches, r.num_switches, r.num_fragmentations) == (6, 12, 13, 10, 1, 2)
    assert (r.num_misses, r.num_false_positives, r.idtp) == (2, 3, 8)
    assert r.mota == round((12 - 2 - 3 - 1) / 12, 6) and r.idf1 == round(16 / 25, 6) and r.motp == round((2 / 11) / 10, 6)
    assert df.where("sequence = 'OVERALL'").first().matches == 10


def test_frames_cut_by_batches(spark):
    dice = random.Random(5)
    rows = [(s, f, a, b, round(dice.uniform(0, 0.5), 3)) for s in "pq" for f in range(40) for a in range(4) for b in range(4) if dice.random() < 0.4]
    near = spark.createDataFrame(rows, "sequence string, frame int, gt_id int, pred_id int, distance double").repartition(3)
    want = {tuple(r) for r in clear_mot.frame_matches(near).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {tuple(r) for r in clear_mot.frame_matches(near).collect()} == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_in_common(spark):
    one = spark.createDataFrame([("p", 1, 1, 0.0, 0.0, 1.0, 1.0, 0)], BOX)
    assert clear_mot.metrics(one, one.where("false")).isEmpty()
