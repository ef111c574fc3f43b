"""Geometry of boxes and headings as column expressions; boxes are top-left x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(name: Column | str) -> Column:
    return F.col(name) if isinstance(name, str) else name


def centre(prefix: str = "") -> tuple[Column, Column]:
    return F.col(f"{prefix}x") + F.col(f"{prefix}w") / 2, F.col(f"{prefix}y") + F.col(f"{prefix}h") / 2


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes with column prefixes ``a`` and ``b``; 0 without a union."""
    ax, ay, aw, ah = (F.col(f"{a}{k}") for k in "xywh")
    bx, by, bw, bh = (F.col(f"{b}{k}") for k in "xywh")
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx)) * F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(zero)


def normal_angle(degrees: Column) -> Column:
    """Into (-180, 180]."""
    turned = F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0
    return F.when(turned == -180.0, 180.0).otherwise(turned)


def heading(vx: Column, vy: Column) -> Column:
    """Direction of motion in degrees; 0 when still."""
    return F.when((vx == 0) & (vy == 0), 0.0).otherwise(normal_angle(F.degrees(F.atan2(vy, vx))))


def relative_bearing(own: str, other: str) -> Column:
    """Bearing of ``other`` seen from ``own``'s heading; columns {prefix}px, py, heading."""
    dx, dy = F.col(f"{other}px") - F.col(f"{own}px"), F.col(f"{other}py") - F.col(f"{own}py")
    return normal_angle(F.degrees(F.atan2(dy, dx)) - F.col(f"{own}heading"))
