"""Track lines with odd spaces and cells, each cell read once."""

from trackspark.sources import mot


def test_odd_lines_and_plain_casts(spark):
    rows = ["  1 , 2,3 ,4,5,6 ,0.5\t", "1 2 3 4 5 6 0.9 1 0.5 77", "# c", "", "1,2,3", "a,2,3,4,5,6", "1,,3,4,5,6", "1,2,3,4,5,6,0.1,2,0.3,x"]
    df = mot.parse(spark.createDataFrame([(r,) for r in rows], "value string"), strict=False)
    assert [(r.frame, r.id, r.confidence, r.class_id, r.visibility) for r in df.collect()] == [(1, 2, 0.5, 0, 1.0), (1, 2, 0.9, 1, 0.5), (1, 2, 0.1, 2, 0.3)]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
