"""Bags are compared frame by frame: only the rows of a first uneven frame are put in order."""

import random

from trackspark.operators import parity

TRACK = "sequence string, frame int, id int, x double, y double, w double, h double, confidence double, class_id int"


def _least(first, second):
    """By the definition: the rows of both sides in order, one by one."""
    key = lambda r: tuple((v is not None, v) for v in r[1:])
    place = 0
    for row in sorted({*first, *second}, key=key):
        n, m = first.count(row), second.count(row)
        place += min(n, m)
        if n != m:
            return place, row[1], row[2]
    return None, None, None


def test_places_are_those_of_all_rows_in_order(spark):
    rnd = random.Random(4)
    rows = [("s", rnd.choice([None, 1, 2, 3, 9]), rnd.randrange(5), float(rnd.randrange(3)), 2.0, 3.0, 4.0, 0.5, 0) for _ in range(120)]
    for at in (0, 60, 119):
        ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        changed = [(*r[:3], r[3] + (k == at) * 0.5, *r[4:]) for k, r in enumerate(ordered)]
        found = parity.first_difference(spark.createDataFrame(rows, TRACK), spark.createDataFrame(changed, TRACK)).first()
        assert (found.kind, found.place, found.frame, found.id) == ("row_content", *_least(ordered, changed))


def test_only_rows_of_uneven_frames_are_kept_for_the_order(spark, monkeypatch):
    kept, write = [], parity.checkpoint
    monkeypatch.setattr(parity, "checkpoint", lambda df: kept.append(write(df)) or kept[-1])
    rows = [("s", k, i, 1.0, 2.0, 3.0, 4.0, 0.5, 0) for k in range(50) for i in range(3)]
    changed = [(*r[:3], r[3] + (r[1] >= 20), *r[4:]) for r in rows]
    found = parity.first_difference(spark.createDataFrame(rows, TRACK), spark.createDataFrame(changed, TRACK)).first()
    assert (found.kind, found.place, found.frame, found.id) == ("row_content", 60, 20, 0)
    assert [df.count() for df in kept] == [50, 6]
