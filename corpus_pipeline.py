"""From documents to packed training sequences: five stages, each written as Parquet and read again.

Counted as part of ``trackspark.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.llm._common import discard, stored
from trackspark.llm.jaccard import jaccard_classes
from trackspark.llm.langid import UNKNOWN, Training, identify, train, training_rows
from trackspark.llm.packing import pack_documents
from trackspark.llm.quality import judged
from trackspark.llm.substring_dedup import remove_repeats

#: Documents whose language is less certain than this go.
MIN_LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or come from a rejected host.

    Null and empty texts have fewer words than the rules ask for and go. Repeated rows are judged alike. Only the
    hosts' counts are kept between the two readings of the texts, so no copy of the texts is written.
    """
    return judged(docs, keep_measures=False).where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a clear language."""
    network = train(training_rows(docs, Training()))
    found = identify(docs, network)
    if network is None:  # nothing is labelled: no language can be told, and none is rejected
        return docs
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id in each group of near copies; rows without an id are not compared.

    Different texts of one id are documents of their own, in order of the text; of rows equal in id and text,
    the one stays whose other columns are least.
    """
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    made = []
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.withColumn("own_id", F.col("doc_id"))
    else:
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = named.repartition("doc_id").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("rest"))
        one = one.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
        one = stored(one.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest], "turn"), "numbered")
        most = one.agg(F.max("turn")).first()[0]
        named = one.withColumn("own_id", F.col("doc_id") * most + F.col("turn") - 1).drop("turn")
    found = jaccard_classes(named.select(F.col("own_id").alias("doc_id"), "text"), needed=made)
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    discard(*made)
    return named.join(gone, named["own_id"] == gone["gone_id"], "left_anti").select(*docs.columns).unionByName(nameless)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 13 words and more that a document of smaller id holds.

    Documents that lose no word keep their text as it is, null and empty ones too; of the others words are joined by
    one space. Rows of one id do not remove each other's words.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = remove_repeats(docs, keep=rest, untouched_as_is=True).withColumnRenamed("kept_text", "text")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens; the pieces, without their ids.

    Null and empty texts are packed as the end id alone; repeated rows and null ids like any other row.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: A trained network and a tokenizer cannot be written in SQL; tests/llm/test_pipeline.py compares the Jaccard stage by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
