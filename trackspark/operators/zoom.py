"""Regions of interest by frame: the union of rectangles, padded, kept inside the picture, and smoothed along a clip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def regions(rects: DataFrame, width: int = 1920, height: int = 1080, padding: float = 1.6, least: int = 160) -> DataFrame:
    """One region per (sequence, frame) around all rectangles (x1, y1, x2, y2) that have an area; in whole pixels, at least one wide and high.

    Each side is ``padding`` times the union's, at least ``least`` and at most the picture's. Halves are rounded to even numbers.
    """
    c = F.col
    whole = rects.where("x2 > x1 and y2 > y1").groupBy("sequence", "frame").agg(*[F.min(k).alias(k) for k in SIDES[:2]], *[F.max(k).alias(k) for k in SIDES[2:]])

    def axis(a: str, b: str, size: int) -> tuple[Column, Column]:
        middle, side = (c(a) + c(b)) / 2, F.least(F.greatest((c(b) - c(a)) * padding, F.lit(float(least))), F.lit(float(size)))
        clamp = lambda x, low, high: F.greatest(low, F.least(F.bround(x).cast("int"), high))
        start = clamp(middle - side / 2, F.lit(0), F.lit(max(size - 2, 0)))
        return start, clamp(middle + side / 2, start + 1, F.greatest(F.lit(size), start + 1))

    (x1, x2), (y1, y2) = axis("x1", "x2", width), axis("y1", "y2", height)
    return whole.select("sequence", "frame", *[v.cast("int").alias(k) for k, v in zip(SIDES, (x1, y1, x2, y2), strict=True)])


def smoothed(found: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Each side moves by ``alpha`` of the way from the region before to its own, rounded to whole pixels at each frame; the first stays.

    As each frame is rounded, a sequence is read in order of frames, in one task that holds a batch and the last region.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for rows in batches:
            sides = rows[list(SIDES)].to_numpy(np.float64)
            out = np.empty(sides.shape, np.int64)
            for i, (sequence, own) in enumerate(zip(rows.sequence, sides, strict=True)):
                last = own if sequence != now or last is None else np.rint(last * (1.0 - alpha) + own * alpha)
                now, out[i] = sequence, last
            yield rows.assign(**{k: out[:, i] for i, k in enumerate(SIDES)})

    rows = found.select("sequence", "frame", *SIDES).repartition("sequence").sortWithinPartitions("sequence", "frame")
    return rows.mapInPandas(run, rows.schema)
