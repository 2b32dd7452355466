"""Geometry on ``array<array<double>>`` points and boxes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_points(text: Column) -> Column:
    """Points of "x,y x,y"."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.transform(F.split(p, ","), lambda v: v.cast("double")))


def polygon_area(points: Column) -> Column:
    """Half the absolute sum of cross products around the polygon; 0 for fewer than three points."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def bbox(points: Column) -> Column:
    """struct(x0, y0, x1, y1); null without points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0.0))
    area = lambda x: (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
    both = side("x0", "x1") * side("y0", "y1")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def padded_box(box: Column, pad: float, width: Column, height: Column) -> Column:
    """A box grown by ``pad`` and kept within the page."""
    return F.struct(
        F.greatest(box["x0"] - pad, F.lit(0.0)).alias("x0"),
        F.greatest(box["y0"] - pad, F.lit(0.0)).alias("y0"),
        F.least(box["x1"] + pad, width.cast("double")).alias("x1"),
        F.least(box["y1"] + pad, height.cast("double")).alias("y1"),
    )


def distinct_pixels(points: Column) -> Column:
    """Points without those on the same pixel as the one before."""
    pixel = lambda p: F.transform(p, lambda v: F.round(v).cast("long"))
    return F.filter(points, lambda p, i: (i == 0) | (pixel(p) != pixel(F.element_at(points, F.when(i == 0, 1).otherwise(i)))))


def polyline_length(points: Column) -> Column:
    following = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    leading = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(leading, following, lambda p, q: F.sqrt(F.pow(q[0] - p[0], 2) + F.pow(q[1] - p[1], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def sign_hash(vector: Column, bits: int = 63) -> Column:
    """One bit for each of the first components: whether it is greater than the next."""
    firsts = F.sequence(F.lit(0), F.lit(bits - 1))
    size = F.size(vector)
    return F.aggregate(firsts, F.lit(0).cast("long"), lambda s, i: F.when(F.get(vector, i) > F.get(vector, F.pmod(i + 1, size)), s * 2 + 1).otherwise(s * 2))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
