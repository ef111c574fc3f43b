"""Ranges of winnowing."""

import pandas as pd

from trackspark.llm import winnow


def test_a_far_id_does_not_fill_one_range(spark):
    ids = [*range(10_000), 10**15, None]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": pd.array(ids, "Int64")}).astype(object).where(lambda d: d.notna(), None), "doc_id long").selectExpr("doc_id", "string(doc_id) as text")
    most = winnow.with_next(docs).where("guest = 0").groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert most <= 2 * winnow.RANGE_ROWS
