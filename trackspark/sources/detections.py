"""Detections by frame: JSON records, a summary, and track rows with made-up ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "frame_index: int, x: double, y: double, w: double, h: double, confidence: double, class_id: int"
SCHEMA = f"clip_id string, frame_index int, timestamp_ms long, model_name string, worker_id string, image_path string, detections array<struct<{BOX}>>"


def read(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Frame records under ``path``: a file per frame, or JSON lines as ``write`` makes them (``multi_line=False``)."""
    return spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)


def write(frames: DataFrame, path: str) -> None:
    """JSON lines, a folder per clip; a file per frame would be millions of small files."""
    frames.write.mode("overwrite").partitionBy("clip_id").json(path)


def _number() -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.size("detections"), F.lit(0)))


def summary(frames: DataFrame) -> DataFrame:
    """Number of detections by frame; missing detections are none."""
    return frames.select("clip_id", "frame_index", "timestamp_ms", _number().alias("num_detections"), "model_name", "worker_id", "image_path")


def pseudo_tracks(frames: DataFrame) -> DataFrame:
    """Track rows of detections: ids -2, -3, ... through the frames of a clip; visibility is 1.

    Counts, not detections, are summed along a clip, and the running number is joined back by frame.
    """
    order = Window.partitionBy("clip_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    counts = frames.select("clip_id", "frame_index", _number().alias("n"))
    before = counts.select("clip_id", "frame_index", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    df = frames.select("clip_id", "frame_index", F.posexplode("detections").alias("at", "d")).join(before, ["clip_id", "frame_index"])
    box = [F.col(f"d.{c}").alias(c) for c in ("x", "y", "w", "h", "confidence", "class_id")]
    return df.select(F.col("clip_id").alias("sequence"), F.col("d.frame_index").alias("frame"), (-2 - F.col("before") - F.col("at")).cast("int").alias("id"), *box, F.lit(1.0).alias("visibility"))
