"""Transponder sidecars (JSON with a ``sync`` object and positions), fixes (CSV), and records in CSV or JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.operators.transponder import frame_of
from trackspark.sources.headed import epoch, headed, key_of, last_of_each, number, pick

POSITION = (
    "frame int, timestamp_ms double, mmsi string, latitude_deg double, longitude_deg double, pixel_x double, pixel_y double, "
    "sog_knots double, cog_deg double"
)
SIDECAR = "version int, sync struct<mode string, time_offset_ms double, video_fps double>, positions array<struct<" + ", ".join(f.replace(" ", ": ") for f in POSITION.split(", ")) + ">>"


def sidecars(spark: SparkSession, path: str, video_fps: float | None = None, offset_ms: float | None = None) -> DataFrame:
    """A row per position of the JSON files below ``path``, one object a file, with its ``file`` and ``frame``.

    Mode ``frame_index`` (the default) takes the frame as it stands; below 1 it is an error. Mode ``timestamp_ms`` derives
    it from the time, the frame rate and the offset of the file; both arguments override the file's. No positive
    frame rate is an error there. A file without positions has no rows.
    """
    files = spark.read.schema(SIDECAR).json(path, multiLine=True).withColumn("file", F.input_file_name())
    df = files.select("file", "sync", F.explode("positions").alias("at")).select("file", "sync", "at.*")
    fps = F.lit(video_fps) if video_fps is not None else F.col("sync.video_fps")
    offset = F.lit(offset_ms) if offset_ms is not None else F.coalesce("sync.time_offset_ms", F.lit(0.0))
    by_index = F.coalesce("sync.mode", F.lit("frame_index")) == "frame_index"
    told = F.when(F.col("frame") >= 1, F.col("frame")).otherwise(F.raise_error(F.concat(F.lit("frame below 1 in "), "file")))
    timed = F.when(fps > 0, frame_of(F.col("timestamp_ms"), fps, offset)).otherwise(F.raise_error(F.concat(F.lit("no positive video_fps for "), "file")))
    return df.withColumn("frame", F.when(by_index, told).otherwise(timed)).drop("sync")


def fixes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of CSV files, each with a header of its own naming columns of a position in any order; ``has_pixel`` says if both pixels are there."""
    cells = headed(spark, path)
    df = cells.select("file", *[pick(F.col("cells"), name).try_cast(kind).alias(name) for name, kind in (f.split() for f in POSITION.split(", "))])
    return df.withColumn("has_pixel", F.col("pixel_x").isNotNull() & F.col("pixel_y").isNotNull())


@dataclass(frozen=True)
class Columns:
    """Names of the columns of transponder files."""

    mmsi: str = "mmsi"
    timestamp: str = "timestamp"
    lat: str = "lat"
    lon: str = "lon"
    x: str = "x"
    y: str = "y"
    sog: str = "sog"
    cog: str = "cog"
    heading: str = "heading"


def _json_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, row number and cells of JSON files: a list of records, or an object of records or lists of records by MMSI, also mixed.

    A record of an object without the name ``mmsi`` gets the object's; of names that compare equal the last counts.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    cells = "map<string,string>"
    listed = lambda text: F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    record = lambda text: F.when(F.ltrim(text).startswith("{"), F.from_json(text, cells))
    own_key = lambda m, key: F.when(F.map_contains_key(m, F.lit("mmsi")), m).otherwise(F.map_concat(m, F.create_map(F.lit("mmsi"), key)))

    def of_entry(e: Column) -> Column:
        texts = F.when(F.ltrim(e["value"]).startswith("["), listed(e["value"])).otherwise(F.array(e["value"]))
        return F.transform(F.filter(F.transform(texts, record), lambda m: m.isNotNull()), lambda m: own_key(m, e["key"]))

    entries = F.map_entries(F.coalesce(F.from_json("value", cells), F.create_map().cast(cells)))
    by_key = F.flatten(F.transform(entries, of_entry))
    plain = F.filter(F.transform(listed(F.col("value")), record), lambda m: m.isNotNull())
    rows = F.when(F.col("value").startswith("["), plain).otherwise(by_key)
    rows = whole.select("file", F.posexplode(rows).alias("at", "cells"))
    return rows.select("file", (F.col("at") + 1).alias("row"), last_of_each(F.transform(F.map_entries("cells"), lambda e: F.struct(key_of(e["key"]).alias("key"), e["value"].alias("value")))).alias("cells"))


def records(spark: SparkSession, path: str, columns: Columns = Columns(), form: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of CSV or JSON files (``form``).

    Records: file, mmsi, timestamp (seconds, also from ISO texts), lat, lon, x, y, sog, cog, heading; numbers that cannot be read are null.
    Warnings: file, cells and reason of each row without an MMSI or a time, which is no record; JSON rows have their number.
    """
    cells = _json_rows(spark, path) if form == "json" else headed(spark, path).withColumn("row", F.lit(None).cast("int"))
    get = lambda name: pick(F.col("cells"), getattr(columns, name))
    mmsi = F.nullif(F.trim(get("mmsi")), F.lit(""))
    df = cells.withColumns({"mmsi": mmsi, "timestamp": epoch(get("timestamp"))})
    reason = F.when(F.col("mmsi").isNull(), "missing MMSI").when(F.col("timestamp").isNull(), "missing or invalid timestamp")
    df = df.withColumn("reason", reason)
    good = df.where("reason is null").select("file", "mmsi", "timestamp", *[number(get(n)).alias(n) for n in ("lat", "lon", "x", "y", "sog", "cog", "heading")])
    return good, df.where("reason is not null").select("file", "row", "cells", "reason")
