"""Similarities by chunks against all pairs."""

import math

from compare import differences

from pyspark.sql import functions as F
from trackspark import queries
from trackspark.operators import appearance


def test_chunks_that_meet_give_all_pairs_once(spark):
    vectors = {i: [float(i % 7 - 3), float(i % 5), 1.0 + i] for i in range(-20, 81)}
    vectors |= {3: None, 20: None, 5: [1.0, None, 2.0], 9: [0.0, 0.0, 0.0]}
    df = spark.createDataFrame([*vectors.items(), (None, [1.0, 1.0, 1.0])], "id long, v array<float>").repartition(4)
    found = appearance.similarities(df, F.col("id") % 20 == 0, "id", "v", chunk=2)
    rows = {(r.a_id, r.b_id): r.similarity for r in found.collect()}
    assert found.count() == len(rows) and set(rows) == {(a, b) for a in vectors if a % 20 == 0 for b in vectors if a != b}
    for (a, b), got in rows.items():
        p, q = vectors[a], vectors[b]
        if not p or not q or None in p + q:
            assert got is None
        elif not any(q):
            assert math.isnan(got)
        else:
            want = sum(x * y for x, y in zip(p, q)) / math.sqrt(sum(x * x for x in p) * sum(y * y for y in q))
            assert abs(got - want) <= 5.1e-7 and got == round(got, 6)


def test_no_pair_of_vectors_is_computed_element_by_element(spark):
    df = queries.QUERIES["cosine_similarity"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "Join" not in plan
    assert not differences(df, queries.ORACLES["cosine_similarity"], "/root/testdata/sf0.001")
