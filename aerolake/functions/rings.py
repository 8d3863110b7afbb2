"""Ring operations that need a loop over vertices: simplification and cutting at the 180th meridian.

Rings are arrays of (lon, lat), the first vertex again at the end. They run in Arrow batches.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

Point = tuple[float, float]


def _far(points: list[Point], first: int, last: int) -> tuple[float, int]:
    """The vertex between first and last that lies furthest from the line through both, and how far."""
    (ax, ay), (bx, by) = points[first], points[last]
    dx, dy = bx - ax, by - ay
    length = math.hypot(dx, dy)
    best = (0.0, first)
    for i in range(first + 1, last):
        px, py = points[i][0] - ax, points[i][1] - ay
        away = abs(dy * px - dx * py) / length if length else math.hypot(px, py)
        if away > best[0]:
            best = (away, i)
    return best


def simplified(ring: list[Point], tolerance: float) -> list[Point]:
    """The ring without vertices within tolerance of the line that is left; whole where under four would stay."""
    if len(ring) < 4:
        return ring
    keep, spans = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while spans:
        first, last = spans.pop()
        away, i = _far(ring, first, last)
        if away > tolerance:
            keep.add(i)
            spans += [(first, i), (i, last)]
    return [ring[i] for i in sorted(keep)] if len(keep) >= 4 else ring


def _unrolled(points: list[Point]) -> list[Point]:
    """The vertices with longitudes that never jump by more than half a turn."""
    out, turn = [points[0]], 0.0
    for (before, _), (lon, lat) in zip(points, points[1:]):
        turn += -360.0 if lon - before > 180 else 360.0 if lon - before < -180 else 0.0
        out.append((lon + turn, lat))
    return out


def _half(points: list[Point], line: float, side: int) -> list[Point]:
    """The part of an open ring at or beyond a meridian, to the east (side 1) or west (side -1)."""
    out: list[Point] = []
    for (alon, alat), (lon, lat) in zip(points[-1:] + points[:-1], points):
        here, before = side * (lon - line) >= 0, side * (alon - line) >= 0
        if here != before:
            out.append((line, alat + (line - alon) / (lon - alon) * (lat - alat)))
        if here:
            out.append((lon, lat))
    return out


def cut(ring: list[Point]) -> list[list[Point]]:
    """The ring's parts on either side of the 180th meridian, each within -180 to 180, closed."""
    open_ = ring[:-1] if ring and ring[0] == ring[-1] else ring
    if len(ring) < 4 or len(open_) < 3:
        return []
    if all(abs(a[0] - b[0]) <= 180 for a, b in zip(open_[-1:] + open_[:-1], open_)):
        return [[*open_, open_[0]]]
    points = _unrolled(open_)
    lons = [p[0] for p in points]
    low, high = (math.floor((x + 180) / 360) for x in (min(lons), max(lons)))
    parts = []
    for k in range(low, high + 1):
        part = points if low == high else _half(_half(points, 360.0 * k + 180, -1), 360.0 * k - 180, 1) if points else []
        if len(part) >= 3:
            moved = [(lon - 360.0 * k, lat) for lon, lat in part]
            parts.append([*moved, moved[0]])
    return parts


_RING = T.ArrayType(T.ArrayType(T.DoubleType()))


def _points(ring) -> list[Point]:
    return [(float(p[0]), float(p[1])) for p in ring]


@F.pandas_udf(T.ArrayType(_RING))
def split_antimeridian(ring: pd.Series) -> pd.Series:
    """The parts of each ring (see `cut`); null and short rings have none."""
    return ring.map(lambda r: [] if r is None else cut(_points(r)))


@F.pandas_udf(_RING)
def simplify_ring(ring: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Each ring simplified (see `simplified`); null stays."""
    return pd.Series([None if r is None else simplified(_points(r), float(t)) for r, t in zip(ring, tolerance)])


@F.pandas_udf(T.ArrayType(_RING))
def simplify_polygon(polygon: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Each polygon with its outline and holes simplified (see `simplified`); null stays."""
    return pd.Series([None if p is None else [simplified(_points(r), float(t)) for r in p] for p, t in zip(polygon, tolerance)])
