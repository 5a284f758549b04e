"""Boxes in points, origin at the top left, as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    top: Column
    x1: Column
    bottom: Column


FIELDS = Box._fields


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{f}") for f in FIELDS))


def box_in(struct: Column) -> Box:
    return Box(*(struct[f] for f in FIELDS))


def area(b: Box) -> Column:
    return F.greatest(b.x1 - b.x0, F.lit(0.0)) * F.greatest(b.bottom - b.top, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that touch or lie apart."""
    w, h = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top)
    both = w * h
    union = area(a) + area(b) - both
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(F.try_divide(both, union))


def center_in(word: Box, region: Box) -> Column:
    """Bounds belong to the region."""
    return ((word.x0 + word.x1) / 2).between(region.x0, region.x1) & ((word.top + word.bottom) / 2).between(region.top, region.bottom)


def overlaps(a: Box, b: Box) -> Column:
    """Touching boxes don't overlap."""
    return (a.x0 < b.x1) & (a.x1 > b.x0) & (a.top < b.bottom) & (a.bottom > b.top)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.top, b.top), F.greatest(a.x1, b.x1), F.greatest(a.bottom, b.bottom))


def inflated(b: Box, by: float, width: Column, height: Column) -> Box:
    return Box(F.greatest(F.lit(0.0), b.x0 - by), F.greatest(F.lit(0.0), b.top - by), F.least(width, b.x1 + by), F.least(height, b.bottom + by))


def unit_scale(unit: Column) -> Column:
    """Points of a unit of length; without a unit, inches."""
    u = F.lower(F.coalesce(unit, F.lit("inch")))
    return F.when(u == "inch", F.lit(72.0)).when(u == "pixel", F.lit(72.0 / 96.0)).otherwise(F.lit(1.0))


def polygon_box(polygon: Column, scale: Column) -> Box:
    """The box of x and y in turn; nulls for fewer than four points."""
    enough = F.size(polygon) >= 8
    at = lambda odd: F.filter(polygon, lambda v, i: i % 2 == odd)
    pick = lambda f, odd: F.when(enough, f(at(odd)) * scale)
    return Box(pick(F.array_min, 0), pick(F.array_min, 1), pick(F.array_max, 0), pick(F.array_max, 1))
