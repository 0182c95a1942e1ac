"""Boxes on a page: structs ``x0, y0, x1, y1`` (and ``page``), compared as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 unless the boxes overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
    return F.when((w <= 0) | (h <= 0) | (union == 0), 0.0).otherwise(F.try_divide(w * h, union))


def center_distance(a: Column, b: Column) -> Column:
    dx = (a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2
    dy = (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def spatial_similarity(a: Column, b: Column, width: Column, height: Column, pixels: float = 10.0, share: float = 0.02) -> Column:
    """0.6 of the overlap and 0.4 of the nearness of centers; 0 on another page.

    Nearness falls to 0 at the tolerance and, beyond it, once more from a half to 0 at twice that.
    """
    reach = F.greatest(F.lit(pixels), share * F.greatest(width, height))
    d = center_distance(a, b)
    near = F.when(d <= reach, 1.0 - d / reach).otherwise(F.greatest(F.lit(0.0), 1.0 - d / (reach * 2)))
    same = F.coalesce(a["page"], F.lit(0)) == F.coalesce(b["page"], F.lit(0))
    return F.when(same, iou(a, b) * 0.6 + near * 0.4).otherwise(0.0)


def proximity_bonus(a: Column, b: Column, most: float = 0.15) -> Column:
    d = center_distance(a, b)
    return F.when(d <= 10, F.lit(most)).when(d <= 50, most * (1.0 - (d - 10) / 40)).otherwise(0.0)
