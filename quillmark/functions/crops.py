"""What a line's crop would be, and polygons as pixels: numpy over rows, for what needs loops over points."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The least baseline, and the largest crop in pages and in pixels.
LEAST_BASELINE, MOST_PAGES, MOST_PIXELS = 5.0, 4.0, 24_000_000
MOST_POINTS = 200


def clean(points) -> np.ndarray:
    """(n, 2) points, each on another pixel than the one before."""
    at = np.array([p[:2] for p in points if len(p) >= 2], float).reshape(-1, 2) if points is not None else np.empty((0, 2))
    keep = np.ones(len(at), bool)
    keep[1:] = (np.rint(at[1:]) != np.rint(at[:-1])).any(1)
    return at[keep]


def crop_size(baseline: np.ndarray, boundary: np.ndarray) -> tuple[int, int] | None:
    """(width, height) of the boundary laid along the baseline; null where a baseline has no length.

    A straight baseline only turns the box. Else each point belongs to the segment that it overshoots
    least; its place is along the baseline, its height beside it.
    """
    if len(baseline) < 2 or not len(boundary):
        return None
    steps = np.diff(baseline, axis=0)
    length = np.hypot(*steps.T)
    if not length.all():
        return None
    if len(baseline) == 2:
        side = int(np.hypot(*np.ptp(boundary, axis=0))) + 2
        return side, side
    if len(boundary) > MOST_POINTS:
        boundary = np.concatenate([boundary[:: len(boundary) // MOST_POINTS + 1], boundary[-1:]])
    unit = steps / length[:, None]
    away = boundary[:, None, :] - baseline[None, :-1, :]
    along = (away * unit).sum(2)
    nearest = np.maximum(-along, along - length).argmin(1)
    row = np.arange(len(boundary))
    x = np.concatenate([[0.0], np.cumsum(length)])[nearest] + along[row, nearest]
    y = unit[nearest, 0] * away[row, nearest, 1] - unit[nearest, 1] * away[row, nearest, 0]
    extent = lambda v: int(v.max()) - int(v.min()) + 1
    return extent(x), extent(y)


def drop_reason(baseline, boundary, width: float | None, height: float | None) -> str | None:
    """Why a line must not be cropped: short_baseline, degenerate_baseline or oversize_crop; null if it may be."""
    line, polygon = clean(baseline), clean(boundary)
    if len(line) < 2 or np.hypot(*np.diff(line, axis=0).T).sum() < LEAST_BASELINE:
        return "short_baseline"
    if len(polygon) < 3:
        return None
    size = crop_size(line, polygon)
    if size is None:
        return "degenerate_baseline"
    return f"oversize_crop:{size[0]}x{size[1]}" if size[0] * size[1] > max(MOST_PAGES * (width or 0) * (height or 0), MOST_PIXELS) else None


@F.pandas_udf(T.StringType())
def crop_reason(baseline: pd.Series, boundary: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """``drop_reason`` of points as JSON."""
    read = lambda t: json.loads(t) if isinstance(t, str) and t else []
    number = lambda v: None if pd.isna(v) else float(v)
    return pd.Series([drop_reason(read(b), read(p), number(w), number(h)) for b, p, w, h in zip(baseline, boundary, width, height, strict=True)], dtype=object)


def mask(polygon, x0: int, y0: int, width: int, height: int) -> np.ndarray:
    """(height, width) pixels whose middles lie in a polygon, by crossings of each row."""
    out = np.zeros((height, width), bool)
    points = np.array(polygon, float).reshape(-1, 2)
    if len(points) < 3:
        return out
    following = np.roll(points, -1, axis=0)
    for row in range(height):
        y = y0 + row + 0.5
        crosses = (points[:, 1] <= y) != (following[:, 1] <= y)
        a, b = points[crosses], following[crosses]
        xs = np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
        for left, right in zip(xs[::2], xs[1::2], strict=False):
            lo, hi = np.clip([np.ceil(left - x0 - 0.5), np.ceil(right - x0 - 0.5)], 0, width).astype(int)
            out[row, lo:hi] = True
    return out


def overlap(a, b) -> tuple[int, int, int]:
    """(shared, of a, of b) pixels of two polygons."""
    both = np.array([*a, *b], float).reshape(-1, 2)
    if not len(both):
        return 0, 0, 0
    x0, y0 = np.floor(both.min(0)).astype(int)
    x1, y1 = np.ceil(both.max(0)).astype(int)
    one, two = (mask(p, x0, y0, max(1, x1 - x0), max(1, y1 - y0)) for p in (a, b))
    return int((one & two).sum()), int(one.sum()), int(two.sum())


def polygon_iou(a, b) -> float:
    """Shared over covered pixels; 0 where nothing is covered."""
    shared, of_a, of_b = overlap(a, b)
    return shared / (of_a + of_b - shared) if of_a + of_b > shared or shared else 0.0


@F.pandas_udf(T.DoubleType())
def iou_of(a: pd.Series, b: pd.Series) -> pd.Series:
    read = lambda p: [list(q) for q in p] if p is not None else []
    return pd.Series([polygon_iou(read(x), read(y)) for x, y in zip(a, b, strict=True)])


def zone_shares(line, zones: dict[str, list]) -> dict[str, float]:
    """For each group of zones (a list of polygons), the share of a line's pixels inside any of them."""
    points = np.array(line, float).reshape(-1, 2)
    if len(points) < 3:
        return {}
    x0, y0 = np.floor(points.min(0)).astype(int)
    x1, y1 = np.ceil(points.max(0)).astype(int)
    box = (x0, y0, max(1, x1 - x0), max(1, y1 - y0))
    own = mask(line, *box)
    if not own.any():
        return {}
    return {g: float((own & np.logical_or.reduce([mask(p, *box) for p in polygons])).sum() / own.sum()) for g, polygons in zones.items() if polygons}


@F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
def shares_in_zones(line: pd.Series, zones: pd.Series) -> pd.Series:
    """``zone_shares`` of a line's points and its page's zones, an array of struct(group, polygon)."""
    out = []
    for points, found in zip(line, zones, strict=True):
        by: dict[str, list] = {}
        for z in found if found is not None else []:
            by.setdefault(z["group"], []).append([list(q) for q in z["polygon"]])
        out.append(zone_shares([list(q) for q in points] if points is not None else [], by))
    return pd.Series(out)
