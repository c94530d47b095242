"""Rectangles and quadrilaterals on normalised pages, as expressions.

A polygon is an array of (x, y) structs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(polygon: Column) -> tuple[Column, Column, Column, Column]:
    """Least and greatest x and y."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def pixel_bounds(box: tuple[Column, Column, Column, Column], width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """x, y, width and height in whole pixels that cover a normalised box."""
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most))).cast("int")
    x0, y0 = inside(F.floor(box[0] * width), width), inside(F.floor(box[1] * height), height)
    x1, y1 = inside(F.ceil(box[2] * width), width), inside(F.ceil(box[3] * height), height)
    return x0, y0, F.greatest(x1 - x0, F.lit(0)), F.greatest(y1 - y0, F.lit(0))


def overlap_ratio(a: tuple, b: tuple) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 for an empty union."""
    width = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    height = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    both = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / union)


def valid_region(polygon: Column, page: Column, pages: Column) -> Column:
    """Page in range, 3 to 32 points inside the unit square, a non-zero area."""
    bad = lambda v: v.isNull() | F.isnan(v) | ~v.between(0, 1)
    n = F.size(polygon)
    turned = F.concat(F.slice(polygon, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    area = F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)
    return (page < pages) & n.between(3, 32) & ~F.exists(polygon, lambda p: bad(p["x"]) | bad(p["y"])) & (F.abs(area) >= 1e-8)


def span_polygon(polygon: Column, chars: Column, start: Column, end: Column) -> Column:
    """The part of a line's quadrilateral that a span of its characters covers; other
    polygons and empty lines are covered whole."""
    a, b = start / F.greatest(chars, F.lit(1)), end / F.greatest(chars, F.lit(1))
    at = lambda i: F.get(polygon, F.lit(i))
    mix = lambda p, q, t: F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
    part = F.array(mix(at(0), at(1), a), mix(at(0), at(1), b), mix(at(3), at(2), b), mix(at(3), at(2), a))
    return F.when((F.size(polygon) == 4) & (chars > 0), part).otherwise(polygon)
