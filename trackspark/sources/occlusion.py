"""Occlusion reports: predictions of hidden tracks by sequence, in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION = (
    "track_id: int, raw_track_id: int, canonical_id: int, frame: int, current_frame: int, predicted_x: double, predicted_y: double, uncertainty_radius: double, gap_frames: int, source: string, visibility_state: string, "
    "last_bbox: array<double>, recovered_by_remap: boolean, same_raw_id_reappeared: boolean, reappearance_frame: int, remap_target_raw_track_id: int, remap_decision_frame: int"
)
REPORT = f"sequences map<string, struct<prediction_count: int, predictions: array<struct<{PREDICTION}>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per prediction of the reports below ``path``: file, sequence, ``shown_at`` (the frame it stands for: the current one, or else its own) and its fields.

    A report is one document, or one a line. Sequences without predictions have no rows.
    """
    whole = spark.read.schema(REPORT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    df = whole.select("file", F.explode("sequences").alias("sequence", "of")).select("file", "sequence", F.explode("of.predictions").alias("p"))
    return df.select("file", "sequence", F.coalesce("p.current_frame", "p.frame").alias("shown_at"), "p.*")


def write(predictions: DataFrame, path: str) -> None:
    """One report a sequence, of the columns sequence and fields of a prediction that are there; null fields are left out. A sequence's predictions are in order of frame and id."""
    fields = [f.split(":")[0] for f in PREDICTION.split(", ")]
    row = F.struct("frame", "track_id", *[c for c in fields if c in predictions.columns and c not in ("frame", "track_id")])
    df = predictions.groupBy("sequence").agg(F.sort_array(F.collect_list(row)).alias("predictions"))
    one = F.struct(F.size("predictions").alias("prediction_count"), F.col("predictions"))
    df = df.select(F.to_json(F.struct(F.create_map(F.col("sequence"), one).alias("sequences"))).alias("value"))
    df.repartition(F.xxhash64("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
