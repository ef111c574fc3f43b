"""Packing without the ids, of pools that are tokenised piece by piece."""

from pyspark.sql import functions as F

from trackspark.llm import packing, queries
from trackspark.llm.packing import pack_documents


def test_pieces_without_ids_are_the_same(spark):
    word = F.concat(F.lit("w"), (F.col("id") * 7919 % 100003).cast("string"), F.lit(" is "))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 != 7, F.repeat(word, (F.col("id") * 37 % 1500 + 1).cast("int"))).alias("text")).coalesce(1)
    assert docs.agg(F.sum(F.octet_length("text"))).first()[0] > 1.5 * packing.ENCODED_BYTES  # several pieces in one pool
    whole, bare = pack_documents(docs, queries.WORD_BPE), pack_documents(docs, queries.WORD_BPE, with_ids=False)
    assert bare.columns == [c for c in whole.columns if c != "ids"]
    rows = whole.collect()
    assert sorted(tuple(r)[:-1] for r in rows) == sorted(map(tuple, bare.collect()))
    for doc in {r.doc_id for r in rows}:
        pieces = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == doc)
        assert [s for s, _, _ in pieces] == [sum(n for _, n, _ in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n, _ in pieces) == pieces[0][2]
