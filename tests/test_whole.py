"""Queries read their whole tables, and files are read strictly."""

import pytest
from pyspark.sql import Row

from trackspark import queries
from trackspark.operators import stitch
from trackspark.sources import mot

SF = "/root/testdata/sf0.01"


def test_every_vessel_has_a_state(spark):
    boxes = queries.observations(spark, SF).selectExpr("sequence", "int(floor(frame / 200)) as span", "id").distinct()
    states = queries.QUERIES["vessel_state"](spark, SF).select("sequence", "span", "id")
    assert boxes.exceptAll(states).isEmpty() and states.count() == boxes.count()


def test_pairs_within_reach_are_all_found(spark):
    states = queries._states(spark, "/root/testdata/sf0.001")
    every = queries.encounters.pairs(states, queries.SPAN)
    far = queries.encounters.distance(*[every[c] for c in ("own_px", "own_py", "other_px", "other_py")])
    want = every.where(far <= 300)
    assert want.exceptAll(queries.encounters.pairs(states, queries.SPAN, reach=300.0)).isEmpty()
    assert queries.encounters.pairs(states, queries.SPAN, reach=300.0).count() == want.count() > 0


def test_cameras_rank_and_match_odd_ids(spark):
    for name in ("rank_x_pairs", "center_distance_candidates"):
        df = queries.QUERIES[name](spark, SF)
        assert df.where("a_id % 2 = 1").count() and df.where("b_id % 2 = 1").count(), name


def test_every_box_is_judged(spark):
    boxes = queries.observations(spark, SF).count()
    assert queries.QUERIES["nearest_boxes"](spark, SF).count() == boxes


def test_each_query_vector_meets_all_others(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    met = queries.QUERIES["cosine_similarity"](spark, SF).groupBy("a_id").agg({"b_id": "count"}).collect()
    assert len(met) == -(-n // 20) and {c for _, c in met} == {n - 1}


def test_last_tracklet_decides_the_remap(spark):
    tracks = spark.createDataFrame([("s", f, i) for f, i in ((1, 2), (5, 5), (9, 5), (7, 6))], "sequence string, frame int, id int")
    pieces = spark.createDataFrame([("s", 2, 0), ("s", 5, 0), ("s", 5, 1), ("s", 6, 0)], "sequence string, id int, segment int")
    decisions = spark.createDataFrame([("s", 5, 0, 2, "accepted"), ("s", 5, 1, 3, "margin_too_small"), ("s", 6, 0, 2, "accepted")], "sequence string, new_id int, new_segment int, canonical_id int, reason string")
    found = {(r.raw_id, r.id) for r in stitch.remap(tracks, pieces, decisions).collect()}
    assert found == {(2, 2), (5, 5), (6, 2)}


def test_track_rows_are_read_strictly(spark):
    lines = lambda *x: spark.createDataFrame([Row(value=v) for v in x])
    good = mot.parse(lines("\t1 2 3 4 5 6", "", "# no row", "2,7,1.5,2,3,4,0.5,1,0.25"), frame_offset=10).collect()
    assert [(r.frame, r.id, r.x, r.confidence, r.class_id, r.visibility) for r in good] == [(11, 2, 3.0, 1.0, 0, 1.0), (12, 7, 1.5, 0.5, 1, 0.25)]
    for bad in ("1,x,3,4,5,6", "1,7,a,b,c,d", "1,2,3", "1,2,3,4,5,6,often"):
        with pytest.raises(Exception, match="not a track row"):
            mot.parse(lines(bad)).collect()
        assert mot.parse(lines(bad, "1,2,3,4,5,6"), strict=False).count() == 1
