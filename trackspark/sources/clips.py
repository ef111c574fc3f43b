"""Aligned clips: manifests found below a folder, whether their files can be used, and true boxes with identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.sources.headed import headed, key_of, last_of_each, number, pick

#: Names that a manifest may use, in order of preference, and the file beside it where it names none. Fixed values.
VIDEO = ("clip_video", "video_file", "video_path", "clip_path")
REPORTS = ("ais_clip_aligned", "ais_file", "ais_clip_aligned_csv")
TRUTH = ("gt_fusion_clip_aligned", "gt_fusion_file", "gt_fusion_clip_aligned_csv")
FPS = ("fps", "clip_fps", "video_fps", "source_fps")
CONFIDENCE = ("offset_confidence", "alignment_confidence", "confidence", "best_offset_confidence")
START = ("clip_effective_start_time", "effective_start_time", "clip_start_time", "video_start_time", "start_time")
REPORT_ROWS = ("ais_rows_in_clip", "ais_row_count")
TRUTH_ROWS = ("gt_fusion_rows_in_clip", "gt_rows_in_clip", "gt_row_count")
#: Columns of true boxes by the names that files use for them. Fixed values.
BOX = {
    "x": ("bb_left", "left", "x", "bbox_left"),
    "y": ("bb_top", "top", "y", "bbox_top"),
    "w": ("bb_width", "width", "w", "bbox_width"),
    "h": ("bb_height", "height", "h", "bbox_height"),
}


def true_boxes(spark: SparkSession, path: str, fps: float | Column = 30.0) -> DataFrame:
    """file, frame, second, mmsi, x, y, w, h, confidence of CSV files with headers of their own.

    A row without a frame takes that of its second at ``fps``, counted from 1; without a second that is 0. Rows without
    an MMSI or a box are skipped.
    """
    cells, fps = F.col("cells"), fps if isinstance(fps, Column) else F.lit(float(fps))
    second = F.coalesce(number(pick(cells, "second", "time", "timestamp")), F.lit(0.0))
    told = number(pick(cells, "frame", "frame_id")).cast("int")
    df = headed(spark, path).select(
        "file", F.coalesce(told, (F.bround(second * fps) + 1).cast("int")).alias("frame"), second.alias("second"), F.trim(pick(cells, "mmsi")).alias("mmsi"),
        *[number(pick(cells, *names)).alias(n) for n, names in BOX.items()], number(pick(cells, "conf", "confidence")).alias("confidence"),
    )
    return df.where("mmsi <> ''").dropna(subset=list(BOX))


def _plain(path: Column) -> Column:
    """A path without scheme, ``.`` and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", ""), r"/(\.?/)+", "/")


def _placed(folder: Column, value: Column, name: str | None) -> tuple[Column, Column]:
    """Where a manifest's path points, and the copy beside the manifest that stands in for it."""
    text = F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit(name)))
    base = F.regexp_extract(F.replace(text, F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    beside = F.concat(folder, F.lit("/"), base)
    foreign = text.rlike(r"^[A-Za-z]:[\\/]") | text.startswith("\\\\")
    own = F.when(foreign, beside).when(text.startswith("/"), text).otherwise(F.concat(folder, F.lit("/"), text))
    return _plain(own), _plain(beside)


def manifests(spark: SparkSession, root: str, pattern: str = "*alignment_manifest.json", least_confidence: float = 0.5, any_confidence: bool = False) -> DataFrame:
    """One row per manifest below ``root``: its values, the files it names, rows in these, and ``skipped``, the reason not to use it (null: none).

    Names in a manifest compare like headers. Paths are relative to it; where one points nowhere, or is one of another
    system, a file of its name beside the manifest is taken. Files are looked up in one listing of ``root``, so those
    elsewhere do not exist. Row counts are the manifest's or else the files'.
    """
    c = F.col
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    entries = F.map_entries(F.from_json(F.regexp_replace("value", "^\ufeff", ""), "map<string,string>"))
    cells = last_of_each(F.transform(entries, lambda e: F.struct(key_of(e["key"]).alias("key"), e["value"].alias("value"))))
    df = found.select(_plain(c("_metadata.file_path")).alias("manifest"), cells.alias("cells")).withColumn("folder", F.regexp_replace("manifest", r"/[^/]*$", ""))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_plain(c("path")).alias("path"))
    for name, names, beside in (("video", VIDEO, None), ("reports", REPORTS, "ais_clip_aligned.csv"), ("truth", TRUTH, "gt_fusion_clip_aligned.csv")):
        own, copy = _placed(c("folder"), pick(c("cells"), *names), beside)
        df = df.withColumns({f"{name}_own": own, f"{name}_copy": copy})
        for which in ("own", "copy"):
            df = df.join(files.select(c("path").alias(f"{name}_{which}"), F.lit(True).alias(f"{name}_{which}_there")), f"{name}_{which}", "left")
        there = F.coalesce(f"{name}_own_there", f"{name}_copy_there", F.lit(False))
        df = df.withColumns({f"{name}_file": F.when(c(f"{name}_own_there") | c(f"{name}_copy_there").isNull(), c(f"{name}_own")).otherwise(c(f"{name}_copy")), f"{name}_there": there})
    lines = headed(spark, f"{root}/", recursive=True).where(F.lower("file").endswith(".csv")).groupBy(_plain(c("file")).alias("path")).agg(F.count("*").alias("lines"))
    for name, names in (("reports", REPORT_ROWS), ("truth", TRUTH_ROWS)):
        df = df.join(lines.select(c("path").alias(f"{name}_file"), c("lines").alias(f"{name}_lines")), f"{name}_file", "left")
        told = number(pick(c("cells"), *names)).cast("long")
        df = df.withColumn(f"{name}_rows", F.when(told > 0, told).otherwise(F.coalesce(f"{name}_lines", F.lit(0))))
    fps, sure = number(pick(c("cells"), *FPS)), number(pick(c("cells"), *CONFIDENCE))
    df = df.withColumns({"fps": F.when(fps > 0, fps).otherwise(30.0), "confidence": sure, "start_time": F.nullif(pick(c("cells"), *START), F.lit(""))})
    unsure = F.when(c("confidence").isNull(), "missing_offset_confidence").when(c("confidence") < least_confidence, F.concat(F.lit("low_offset_confidence:"), F.format_string("%.4f", "confidence")))
    skipped = (
        F.when(~c("video_there"), "missing_clip_video").when(~c("reports_there"), "missing_ais_clip_aligned_csv").when(~c("truth_there"), "missing_gt_fusion_clip_aligned_csv")
        .when(c("reports_rows") <= 0, "no_ais_rows_in_clip").when(c("truth_rows") <= 0, "no_gt_fusion_rows_in_clip").when(F.lit(not any_confidence), unsure)
    )
    return df.select("manifest", "fps", "confidence", "start_time", "video_file", "reports_file", "truth_file", "reports_rows", "truth_rows", skipped.alias("skipped"))
