"""Quality rules with verdicts by host, in DataFrame functions only.

Every document is measured by simple rules. Failures are counted by host (the ``source`` column), the
failure rate of a host is shrunk with a beta prior fitted to all hosts' rates by the method of moments,
and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Characters between words, and characters that count as symbols.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits; shares are in per cent."""

    min_words: int = 20
    max_repeat_share: int = 30
    max_symbol_share: int = 50
    max_dup_line_share: int = 50
    max_host_rate: float = 0.5


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as a struct ``row`` beside its text's measures; null and empty texts measure 0."""
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = docs.select(F.struct("*").alias("row"))
    df = df.select("row", words_of(F.col(f"row.{text_col}")).alias("w"), lines.alias("lines"), F.translate(text, BLANKS, "").alias("solid"))
    df = df.select(
        "row",
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
        F.size("w").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        (F.length("solid") - F.length(F.translate("solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rest = ["row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    step = 1  # hashes of 2, 4 and 8 words: the tail past the last window is cut off below
    while step < WINDOW:
        df = df.select(*rest, F.zip_with("h", F.slice("h", step + 1, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)).alias("h"))
        step *= 2
    df = df.select(*rest, F.slice("h", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")).alias("h"))
    # windows side by side with equals; documents without a repeated window, nearly all, sort nothing
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.select(*rest, F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("s"))
    same = lambda x, i: ((i > 0) & (F.get("s", i - 1)["h"] == x["h"])) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))
    df = df.select(*rest, F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])).alias("p"))
    # a repeated window covers its words up to the next one's start
    covered = F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.when(b.isNull(), WINDOW).otherwise(F.least(F.lit(WINDOW), b - a)))
    return df.select(*rest, F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long").alias("n_repeat_words"))


def host_verdicts(failures: DataFrame, max_rate: float) -> DataFrame:
    """(host, failed) -> host, shrunk failure rate, rejected. Without hosts the result is empty.

    Shrunk rate: (failures + a) / (documents + a + b). Beta(a, b) has the mean and variance of the hosts'
    rates; its weight a + b is kept between 1 and 10000 documents, and is 10000 if the rates do not vary.
    """
    hosts = stored(failures.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f")), "hosts")
    rate = F.col("f") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    m, v = m or 0.0, v or 0.0
    weight = min(10000.0, max(1.0, m * (1 - m) / v - 1)) if v > 1e-12 else 10000.0
    shrunk = (F.col("f") + m * weight) / (F.col("n") + weight)
    return hosts.select("host", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_rejected"))


def judged(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", host_col: str = "source", keep_measures: bool = True) -> DataFrame:
    """Each row of ``docs`` (in ``row``) with its measures, base_failed, host_rate, host_rejected and kept.

    Null hosts are one host of their own. Repeated rows are judged alike. Columns of ``docs`` stay inside
    ``row``, so their names cannot clash. An empty table gives an empty result. The measured rows are stored, or
    measured twice if not ``keep_measures``.
    """
    return _verdict(measured(docs, text_col), rules, host_col, keep_measures)


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures and verdict by document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[host_col].alias("source"))
    slim = measured(docs).withColumn("row", F.struct("row.doc_id", "row.source"))
    return _verdict(slim, rules, "source").select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _verdict(df: DataFrame, rules: Rules, host_col: str, keep_measures: bool = True) -> DataFrame:
    share = lambda part, whole, most: F.col(part) * 100 > F.col(whole) * most
    base = (F.col("n_words") < rules.min_words) | share("n_repeat_words", "n_words", rules.max_repeat_share)
    df = df.withColumn("base_failed", base)
    df = df.withColumn("failed", F.col("base_failed") | share("n_symbols", "n_words", rules.max_symbol_share) | share("n_dup_lines", "n_lines", rules.max_dup_line_share))
    df = df.withColumn("host", F.col(f"row.{host_col}").cast("string"))
    if keep_measures:
        df = stored(df, "quality")
    # stored, the verdicts' size is known: they are broadcast only while they are few
    verdicts = stored(host_verdicts(df.select("host", "failed"), rules.max_host_rate).withColumnRenamed("host", "h"), "verdicts")
    df = df.join(verdicts, F.col("host").eqNullSafe(F.col("h"))).drop("h", "host")
    # one condition over both sides of the join: a part of it pushed below would be computed anew for each word list it needs
    return df.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~F.col("host_rejected")))
