"""Plane and sphere geometry as column expressions: no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternway.functions.constants import CELL_SPAN, EARTH_M, PI, RESOLUTION


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def cell_id(x: Column, y: Column, resolution: float | Column = RESOLUTION) -> Column:
    """Grid cell number; the sign is lost, so mirrored coordinates share a cell."""
    r = lit(resolution)
    return F.floor(F.abs(x) / r) * F.lit(CELL_SPAN).cast("long") + F.floor(F.abs(y) / r)


def cell_index(v: Column, low: Column, resolution: float | Column = RESOLUTION) -> Column:
    """Signed column or row number of a coordinate, counted from `low`."""
    r = lit(resolution)
    return F.floor(v / r) - F.floor(low / r)


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whole degrees from the first to the second point, 0 to 359; tiny differences count as none."""
    flat = lambda d: F.when(F.abs(d) < 0.00001, F.lit(0.0)).otherwise(d)
    return F.pmod((F.atan2(flat(y2 - y1), flat(x2 - x1)) * 180 / F.lit(PI) + 0.5).cast("int"), F.lit(360))


def relative_angle(first: Column, second: Column) -> Column:
    """second - first, wrapped into -180 to 180."""
    d = second - first
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def turn(first: Column, second: Column) -> Column:
    """The size of the relative angle, 0 to 180, with each angle written once in the plan."""
    return F.abs(180 - F.pmod(180 - (second - first), F.lit(360)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M, pi: float = PI) -> Column:
    """Great-circle distance in the unit of `radius`, with the given value of pi."""
    rad = lambda d: d * F.lit(pi) / 180
    a = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * F.lit(radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance in degrees."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def foot(px: Column, py: Column, fx: Column, fy: Column, tx: Column, ty: Column) -> Column:
    """Where a point's foot is on a line, from 0 at the `to` end to 1; null for a line without length."""
    dx, dy = fx - tx, fy - ty
    return F.try_divide((px - tx) * dx + (py - ty) * dy, dx * dx + dy * dy)


def to_foot(u: Column, px: Column, py: Column, fx: Column, fy: Column, tx: Column, ty: Column) -> Column:
    """Distance of a point to its foot `u`. Plans with many points keep `u` as a column of its own."""
    return planar(px, py, tx + u * (fx - tx), ty + u * (fy - ty))


def _foot(px: Column, py: Column, fx: Column, fy: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    u = foot(px, py, fx, fy, tx, ty)
    return u, to_foot(u, px, py, fx, fy, tx, ty)


def point_line(px: Column, py: Column, fx: Column, fy: Column, tx: Column, ty: Column, anywhere: bool, outside: float = RESOLUTION) -> Column:
    """Distance of a point to a line.

    `anywhere`: the least of the distances to the infinite line and to both ends. Otherwise the
    perpendicular distance, or `outside` if its foot is not on the segment.
    """
    u, away = _foot(px, py, fx, fy, tx, ty)
    if anywhere:
        return F.least(away, planar(px, py, fx, fy), planar(px, py, tx, ty))
    return F.when((u < 0) | (u > 1), F.lit(outside)).otherwise(away)


def beside_line(px: Column, py: Column, fx: Column, fy: Column, tx: Column, ty: Column) -> Column:
    """True if the foot is on the segment and the point is much nearer to it than to the ends."""
    u, away = _foot(px, py, fx, fy, tx, ty)
    near = (away < 0.5 * planar(px, py, fx, fy)) & (away < 0.5 * planar(px, py, tx, ty)) & (away < 0.3 * planar(fx, fy, tx, ty))
    return F.coalesce((u >= 0) & (u <= 1) & near, F.lit(False))


def hits_line(x0: Column, y0: Column, x1: Column, y1: Column, fx: Column, fy: Column, tx: Column, ty: Column) -> Column:
    """True if two points run along a segment: mid-point beside it, and within 45 degrees."""
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    u, away = _foot(mx, my, fx, fy, tx, ty)
    bend = turn(angle(x0, y0, x1, y1), angle(fx, fy, tx, ty))
    near = (away < planar(mx, my, fx, fy)) & (away < planar(mx, my, tx, ty)) & (away < planar(fx, fy, tx, ty))
    return F.coalesce((u >= -0.3) & (u <= 1.3) & (bend <= 45) & near, F.lit(False))


def well_conditioned(link_distance: Column, segment_distance: Column, cutoff: float = 3.0) -> Column:
    """True if link and GPS segment differ by less than the factor `cutoff`."""
    ratio = link_distance / F.greatest(F.lit(0.00000001), segment_distance)
    return (ratio > F.lit(1.0 / cutoff)) & (ratio < F.lit(cutoff))


def polyline_length(points: Column) -> Column:
    """Planar length of an array of (x, y); 0 for fewer than two points."""
    pairs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: planar(a["x"], a["y"], b["x"], b["y"]))
    return F.when(F.size(points) >= 2, F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)).otherwise(F.lit(0.0))
