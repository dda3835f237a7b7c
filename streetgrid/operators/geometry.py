"""Exact geometry on circles, sectors, segments and rings as column expressions in flat metres around the circle's centre."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import bearing, heading_error


def _clamp(t: Column) -> Column:
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def _per(a: Column, b: Column) -> Column:
    """A quotient that is null where the divisor is zero: Spark may evaluate it for rows whose condition rules it out."""
    return a / F.nullif(b, F.lit(0.0))


def segment_distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from the origin to a segment; a segment of no length is a point."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.when(square > 0, _clamp(_per(-(x0 * dx + y0 * dy), square))).otherwise(0.0)
    return F.sqrt(F.pow(x0 + t * dx, 2) + F.pow(y0 + t * dy, 2))


def length_in_circle(x0: Column, y0: Column, x1: Column, y1: Column, r: float) -> Column:
    """Length of a segment inside the circle of radius ``r`` around the origin."""
    dx, dy = x1 - x0, y1 - y0
    a, b, c = dx * dx + dy * dy, x0 * dx + y0 * dy, x0 * x0 + y0 * y0 - r * r
    root = b * b - a * c
    t = F.sqrt(F.greatest(root, F.lit(0.0)))
    inside = _clamp(_per(-b + t, a)) - _clamp(_per(-b - t, a))
    return F.when((a > 0) & (root > 0), inside * F.sqrt(a)).otherwise(0.0)


def edge_area(x0: Column, y0: Column, x1: Column, y1: Column, r: float) -> Column:
    """Signed area that an edge spans with the origin inside the circle: the edges of a ring add up to its clipped area.

    Inside the circle the piece is a triangle, outside a circular sector.
    """
    dx, dy = x1 - x0, y1 - y0
    a, b, c = dx * dx + dy * dy, x0 * dx + y0 * dy, x0 * x0 + y0 * y0 - r * r
    root = b * b - a * c
    s = F.sqrt(F.greatest(root, F.lit(0.0)))
    t1, t2 = _clamp(_per(-b - s, a)), _clamp(_per(-b + s, a))
    ax, ay, bx, by = x0 + t1 * dx, y0 + t1 * dy, x0 + t2 * dx, y0 + t2 * dy
    angle = lambda px, py, qx, qy: F.atan2(px * qy - py * qx, px * qx + py * qy)
    crossing = 0.5 * (ax * by - ay * bx) + 0.5 * r * r * (angle(x0, y0, ax, ay) + angle(bx, by, x1, y1))
    return F.when(a == 0, 0.0).when(root <= 0, 0.5 * r * r * angle(x0, y0, x1, y1)).otherwise(crossing)


def square_in_circle(x: Column, y: Column, half: Column, r: float) -> Column:
    """Area of an axis-parallel square around (x, y) inside the circle."""
    corners = [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]
    total = F.lit(0.0)
    for (px, py), (qx, qy) in zip(corners, corners[1:] + corners[:1], strict=True):
        total = total + edge_area(px, py, qx, qy, r)
    return F.abs(total)


def in_sector(x: Column, y: Column, heading: Column, r: float, half_angle: float) -> Column:
    """A point is in the sector around a heading; its apex is."""
    near = x * x + y * y <= r * r
    return near & (((x == 0) & (y == 0)) | (heading_error(heading, bearing(x, y)) <= half_angle))


def segment_in_sector(x0: Column, y0: Column, x1: Column, y1: Column, heading: Column, r: float, half_angle: float) -> Column:
    """A segment meets the sector: an end is inside, or it crosses one of the two radii, or the arc."""
    dx, dy = x1 - x0, y1 - y0
    hit = in_sector(x0, y0, heading, r, half_angle) | in_sector(x1, y1, heading, r, half_angle)
    for side in (-half_angle, half_angle):
        angle = F.radians(heading + side)
        ex, ey = r * F.sin(angle), r * F.cos(angle)
        cross = dx * ey - dy * ex
        t, u = _per(ex * y0 - ey * x0, cross), _per(dx * y0 - dy * x0, cross)
        hit = hit | F.coalesce((cross != 0) & t.between(0, 1) & u.between(0, 1), F.lit(False))
    a, b, c = dx * dx + dy * dy, x0 * dx + y0 * dy, x0 * x0 + y0 * y0 - r * r
    root = b * b - a * c
    s = F.sqrt(F.greatest(root, F.lit(0.0)))
    for t in (_per(-b - s, a), _per(-b + s, a)):
        turn = heading_error(heading, bearing(x0 + t * dx, y0 + t * dy))
        hit = hit | F.coalesce((a > 0) & (root >= 0) & t.between(0, 1) & (turn <= half_angle), F.lit(False))
    return hit


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """A point is in a closed ring of (x, y) structs by ray casting; its edge counts as in."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        at = p["x"] + _per(y - p["y"], q["y"] - p["y"]) * (q["x"] - p["x"])
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    def touches(e: Column) -> Column:
        p, q = e["p"], e["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (cross == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(edges, touches) | (F.size(F.filter(edges, crosses)) % 2 == 1)


def point_in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """In the first ring and in none of the holes behind it (a hole's edge counts as the polygon's)."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    inside = lambda ring: point_in_ring(x, y, ring)
    return inside(rings[0]) & ~F.exists(holes, inside)


def circle_area(r: float) -> float:
    return math.pi * r * r
