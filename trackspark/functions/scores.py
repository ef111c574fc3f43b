"""Scores between 0 and 1 as column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def rounded(value: Column, digits: int) -> Column:
    """``F.round(value, digits)``, by whole numbers where these decide: decimals are only asked near ties and for very large values."""
    scaled = value * 10.0**digits
    whole = F.rint(scaled)
    clear = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - whole) <= 0.499)
    return F.when(clear, whole / 10.0**digits + 0.0).otherwise(F.round(value, digits))  # plus 0: no negative zero


def round_six(value: Column) -> Column:
    return rounded(value, 6)


def millionths(values: np.ndarray) -> np.ndarray:
    """``round_six`` of numbers below a million million inside a task, in whole millionths."""
    scaled = values * 1e6
    out = np.rint(scaled).astype(np.int64)
    for at in np.flatnonzero(np.abs(scaled - out) > 0.499):
        out[at] = int((Decimal(repr(float(values[at]))) * 1_000_000).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def threshold_score(value: Column, most: Column) -> Column:
    """1 at 0, 0 at ``most``; 1 if there is no positive limit."""
    return F.when(most.isNull() | (most <= 0), 1.0).otherwise(clamp01(1 - value / most))


def ratio_score(ratio: Column, most: float) -> Column:
    """1 at ratio 1, 0 at ``most``."""
    if most <= 1:
        return F.when(ratio <= 1, 1.0).otherwise(0.0)
    return F.when(ratio <= 1, 1.0).otherwise(clamp01(1 - (ratio - 1) / (most - 1)))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in parts)
    return sum((c * w for c, w in parts), F.lit(0.0)) / total if total > 0 else F.lit(0.0)
