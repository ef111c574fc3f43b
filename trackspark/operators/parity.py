"""Whether two sets of track rows are equal, and where they first differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scores import rounded
from trackspark.plans.storage import checkpoint

ROW = ["frame", "id", "x", "y", "w", "h", "confidence", "class_id"]


def _rounded(tracks: DataFrame, n: str) -> DataFrame:
    boxes = [rounded(F.col(c), 4).alias(c) for c in "xywh"]
    df = tracks.select("sequence", "frame", "id", *boxes, rounded(F.col("confidence"), 6).alias("confidence"), "class_id")
    return df.withColumns({c: F.lit(int(c == n)) for c in ("n_first", "n_second")})


def _bags(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sequence", *ROW).agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"))


def first_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per sequence: its rows on both sides and how they differ, as bags of rounded rows.

    ``kind`` is null if they are equal, ``row_count`` if they are not equally many, else ``row_content`` with the place
    in sorted order (from 0), frame and id of the least row that is not equally often on both sides. Bags are first compared frame by
    frame; only the rows of a sequence's first uneven frame are put in order.
    """
    c = F.col
    both = _rounded(first, "n_first").unionByName(_rounded(second, "n_second"))
    frame = F.coalesce(c("frame").cast("long"), F.lit(-(1 << 40)))  # rows without a frame come first
    common, odd = F.least("n_first", "n_second"), c("n_first") != c("n_second")
    frames = _bags(both).groupBy("sequence", frame.alias("at")).agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"), F.sum(common).alias("common"), F.count_if(odd).alias("odd"))
    frames = checkpoint(frames)  # a row a frame
    found = frames.groupBy("sequence").agg(F.sum("n_first").alias("rows_first"), F.sum("n_second").alias("rows_second"), F.min(F.when(c("odd") > 0, c("at"))).alias("at"))
    before = frames.withColumnRenamed("at", "earlier").join(found.select("sequence", "at"), "sequence").where("earlier < at").groupBy("sequence").agg(F.sum("common").alias("before"))
    counted = c("rows_first") != c("rows_second")
    asked = found.where(~counted & c("at").isNotNull()).select("sequence", "at")
    near = _bags(both.withColumn("at", frame).join(F.broadcast(asked), ["sequence", "at"], "left_semi")).withColumn("row", F.struct(*ROW))
    near = checkpoint(near)  # a frame a sequence
    least = near.groupBy("sequence").agg(F.min(F.when(odd, c("row"))).alias("odd"))
    ahead = near.join(F.broadcast(least), "sequence").where(c("row") <= c("odd")).groupBy("sequence").agg(F.sum(common).alias("within"), F.first("odd").alias("odd"))
    kind = F.when(counted, "row_count").when(c("odd").isNotNull(), "row_content")
    place = {"place": F.coalesce("before", F.lit(0)) + c("within"), "frame": c("odd.frame"), "id": c("odd.id")}
    return found.join(before, "sequence", "left").join(ahead, "sequence", "left").select("sequence", kind.alias("kind"), "rows_first", "rows_second", *[F.when(~counted, v).alias(k) for k, v in place.items()])
