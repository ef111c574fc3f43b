"""Transponder positions and times in terms of a picture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def project(lon: Column, lat: Column, matrix: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """Pixel of a position by an affine (2 x 3) or projective (3 x 3) matrix; null where the latter has no finite point."""
    if len(matrix) not in (2, 3) or any(len(row) != 3 for row in matrix):
        raise ValueError("a matrix of 2 x 3 or 3 x 3 numbers is needed")
    x, y, *last = [a * lon + b * lat + c for a, b, c in matrix]
    if not last:
        return x, y
    usable = F.abs(last[0]) >= 1e-9
    return F.when(usable, x / last[0]), F.when(usable, y / last[0])


def frame_of(timestamp_ms: Column, fps: float, offset_ms: int = 0) -> Column:
    """Frame, from 1, that shows a time; times before the first frame count as frame 1."""
    after = timestamp_ms - offset_ms
    return F.when(after < 0, 1).otherwise(F.greatest(F.lit(1), F.floor(after / 1000.0 * fps) + 1)).cast("int")
