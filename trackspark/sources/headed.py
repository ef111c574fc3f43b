"""CSV files of one folder whose headers differ, each read by its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most columns of a file; one with more is an error.
MOST = 128


def key_of(name: Column) -> Column:
    """Names compare in lower case, without blanks around them, and with blanks inside as ``_``."""
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _cells(line: Column) -> Column:
    """Cells of a CSV line, quoted ones too; empty ones are ''. A mark behind the last cell tells how many there are."""
    names, mark = [f"c{i}" for i in range(MOST + 2)], "\x01end"
    row = F.from_csv(F.concat(line, F.lit(f",{mark}")), ", ".join(f"{n} string" for n in names))
    counted = lambda cells: F.slice(cells, 1, F.greatest(F.array_position(cells, mark).cast("int") - 1, F.lit(0)))
    return F.transform(_once(_once(row, lambda r: F.array(*[r[n] for n in names])), counted), lambda x: F.coalesce(x, F.lit("")))


def last_of_each(entries: Column) -> Column:
    """A map of entries (key, value), where of equal keys the last counts."""

    def kept(all_of: Column) -> Column:
        later = lambda e, i: F.exists(F.slice(all_of, i + 2, F.size(all_of)), lambda x: x["key"] == e["key"])
        return F.filter(F.transform(all_of, lambda e, i: F.when(~later(e, i), e)), lambda e: e.isNotNull())

    return F.map_from_entries(_once(entries, kept))


def headed(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file and cells (a map from the header's names, see ``key_of``, to text) of every line below the first of each file.

    The first line of each file is found by its place, not by its content, and joined to the file's lines. Blank lines
    are skipped; a line may have fewer cells than the header, and what is beyond it is dropped. A byte order mark is no part of a name, and of
    two columns of one name the last counts. Cells may be quoted but hold no line breaks.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.rtrim(F.regexp_replace("value", "^\ufeff", ""), F.lit("\r")).alias("value"))
    heads = lines.where("at.block = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("head_at"))
    names = F.transform(_cells(F.col("head")), key_of)
    heads = heads.withColumn("names", names)
    names = F.col("names")
    wide = F.when((F.size(names) > MOST) | ((F.size(names) == 0) & (F.trim("head") != "")), F.raise_error(F.concat(F.lit(f"more than {MOST} columns in "), "file")).cast("array<string>")).otherwise(names)
    heads = heads.select("file", "head_at", wide.alias("names"))
    rows = lines.join(heads, "file").where("at <> head_at and trim(value) <> ''")
    df = rows.select("file", F.col("names"), _cells(F.col("value")).alias("cells"))
    entries = F.filter(F.zip_with("names", "cells", lambda n, c: F.struct(n.alias("key"), c.alias("value"))), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return df.select("file", last_of_each(entries).alias("cells"))


def pick(cells: Column, *names: str) -> Column:
    """The cell of the first of ``names`` that the file has, whatever it holds; null if it has none."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        key = name.strip().lower().replace(" ", "_")
        out = F.when(F.map_contains_key(cells, F.lit(key)), cells[key]).otherwise(out)
    return out


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def epoch(text: Column) -> Column:
    """Seconds: a number as it stands, or a date and time in ISO form, in UTC where it names no zone; else null."""
    text = F.trim(text)
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.contains(":"), text).otherwise(F.concat(text, F.lit("Z")))
    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.coalesce(text.try_cast("double"), F.when(text.rlike(r"^\d{4}-"), F.unix_micros(zoned.try_cast("timestamp")) / 1e6))
