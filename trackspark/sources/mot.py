"""Track files: text rows ``frame,id,x,y,w,h[,confidence[,class_id[,visibility]]]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(lines: DataFrame, line: str = "value", sequence: Column | None = None, strict: bool = True, where: Column | None = None, frame_offset: int = 0) -> DataFrame:
    """Rows of text lines; blank lines and ``#`` comments are skipped.

    Cells are split on commas, or on white space if there is no comma. Fewer than six cells, or a cell that is no
    number, raise an error with ``where`` (such as the file) and the line, or are skipped unless ``strict``. Numbers are
    truncated to integers where columns are integers; ``frame_offset`` is added to frames.
    """
    text = F.when(F.col(line).rlike(r"^\s|\s$"), F.regexp_replace(line, r"^\s+|\s+$", "")).otherwise(F.col(line))
    df = lines.select(text.alias("line"), (sequence if sequence is not None else F.lit(None).cast("string")).alias("sequence"), (where if where is not None else F.lit("")).alias("where"))
    df = df.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    commas = F.col("line").contains(",")
    cells = F.when(commas & ~F.col("line").rlike(r"\s"), F.split("line", ",")).when(commas, F.split("line", r"\s*,\s*")).otherwise(F.split("line", r"\s+"))
    df = df.withColumn("c", F.slice(cells, 1, 9))
    # each cell is read once
    df = df.select("line", "sequence", "where", F.size("c").alias("cells"), *[F.expr(f"try_cast(get(c, {i}) as double)").alias(f"n{i}") for i in range(9)])
    good = F.col("cells") >= 6
    for i in range(9):
        good &= (F.col("cells") <= i) | F.col(f"n{i}").isNotNull()
    if strict:
        error = F.raise_error(F.concat(F.lit("not a track row: "), "where", F.lit(" "), "line")).cast("double")
        df = df.select("sequence", good.alias("good"), "where", "line", *[F.col(f"n{i}") for i in range(9)])
        number = lambda i: F.when(F.col("good"), F.col(f"n{i}")).otherwise(error)
    else:
        df = df.where(good)
        number = lambda i: F.col(f"n{i}")
    box = [number(i + 2).alias(n) for i, n in enumerate("xywh")]
    rest = [F.coalesce(number(6), F.lit(1.0)).alias("confidence"), F.coalesce(number(7), F.lit(0.0)).cast("int").alias("class_id"), F.coalesce(number(8), F.lit(1.0)).alias("visibility")]
    return df.select("sequence", (number(0).cast("int") + frame_offset).alias("frame"), number(1).cast("int").alias("id"), *box, *rest)


def read(spark: SparkSession, path: str, strict: bool = True, frame_offset: int = 0) -> DataFrame:
    """Track files under ``path``; the sequence is the file's stem."""
    lines = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.col("_metadata.file_path").alias("file"))
    return parse(lines, sequence=F.col("stem"), strict=strict, where=F.col("file"), frame_offset=frame_offset)


def lines(tracks: DataFrame) -> DataFrame:
    """Track rows as text: four digits for boxes, six for confidence and visibility."""
    return tracks.select("sequence", F.format_string("%d,%d,%.4f,%.4f,%.4f,%.4f,%.6f,%d,%.6f", "frame", "id", "x", "y", "w", "h", "confidence", "class_id", "visibility").alias("value"))


def write(tracks: DataFrame, path: str) -> None:
    """One folder of text files per sequence."""
    lines(tracks).write.mode("overwrite").partitionBy("sequence").text(path)
