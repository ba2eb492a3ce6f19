"""Boxes and polygons of page regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Corners in order and inside the page, as whole pixels."""
    cut = lambda v, most: F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), most.cast("int")))
    return F.struct(cut(F.least(x1, x2), width).alias("x1"), cut(F.least(y1, y2), height).alias("y1"), cut(F.greatest(x1, x2), width).alias("x2"), cut(F.greatest(y1, y2), height).alias("y2"))


def padded_box(box: Column, pad: int, width: Column, height: Column) -> Column:
    return F.struct(
        F.greatest(F.lit(0), box["x1"] - pad).alias("x1"), F.greatest(F.lit(0), box["y1"] - pad).alias("y1"), F.least(width.cast("int"), box["x2"] + pad).alias("x2"), F.least(height.cast("int"), box["y2"] + pad).alias("y2")
    )


def relative_box(box: Column, width: Column, height: Column) -> Column:
    """The box as shares of the page."""
    return F.struct(*[(box[c] / (width if c[0] == "x" else height)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def relative_polygon(points: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: F.array(p[0] / width, p[1] / height))


def ordered_points(points: Column) -> Column:
    """Corners from top left clockwise: the least x + y, the least y - x, the greatest x + y, the greatest y - x.

    Of equal ones the first counts.
    """
    ranked = lambda value, sign: F.transform(points, lambda p, i: F.struct(value(p).alias("v"), (i * sign).alias("i")))
    place, turn = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    least = lambda value: F.array_min(ranked(value, 1))["i"]
    most = lambda value: -F.array_max(ranked(value, -1))["i"]
    at = lambda i: F.get(points, i)
    return F.array(at(least(place)), at(least(turn)), at(most(place)), at(most(turn)))


def polygon_box(points: Column) -> Column:
    """The box around an array of [x, y]."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def segmentation_mode(width: Column, height: Column, asked: Column | None = None) -> Column:
    """Which page layout a text reader should assume for a crop: a line (7), a word (8) or a block (6); a number that is asked for wins."""
    ratio = width / F.greatest(height, F.lit(1))
    own = F.when((height <= 40) & (ratio >= 4.0), 7).when((width <= 120) & (height <= 80), 8).when((ratio >= 2.5) & (height <= 80), 7).otherwise(6)
    return own if asked is None else F.when(asked != "auto", asked.cast("int")).otherwise(own)
