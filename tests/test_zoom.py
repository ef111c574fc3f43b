"""Regions by hand, smoothing by a loop."""

from trackspark.operators import zoom

RECT = "sequence string, frame int, x1 double, y1 double, x2 double, y2 double"


def test_regions_by_hand(spark):
    rows = [("s", 1, 100.0, 100.0, 200.0, 150.0), ("s", 1, 300.0, 120.0, 400.0, 300.0), ("s", 1, 900.0, 0.0, 900.0, 5.0), ("s", 2, -500.0, -500.0, 5000.0, 5000.0), ("s", 3, 1915.0, 1075.0, 1919.0, 1079.0), ("s", 4, 5.0, 5.0, 5.0, 9.0)]
    got = {r.frame: tuple(r)[2:] for r in zoom.regions(spark.createDataFrame(rows, RECT)).collect()}
    # frame 1: the union is 100..400 by 100..300, padded to 480 by 320 around (250, 200); frame 2: the whole picture's size around the middle
    assert got == {1: (10, 40, 490, 360), 2: (1290, 1078, 1920, 1080), 3: (1837, 997, 1920, 1080)}


def test_smoothing_by_a_loop(spark):
    rows = [(s, f, (f * 37) % 900, (f * 91) % 500, 900 + (f * 53) % 900, 500 + (f * 17) % 500) for s in "pq" for f in range(0, 120, 3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = zoom.smoothed(spark.createDataFrame(rows, "sequence string, frame int, x1 int, y1 int, x2 int, y2 int").repartition(3))
        got = {tuple(r)[:2]: tuple(r)[2:] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for s, f, *own in rows:
        last[s] = own if s not in last else [round(a * 0.75 + b * 0.25) for a, b in zip(last[s], own)]
        want[s, f] = tuple(last[s])
    assert got == want
