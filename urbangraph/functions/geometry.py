"""Plane geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def orientation(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360)."""
    a = F.degrees(F.atan2(dy, dx))
    return F.when(a < 0, a + 360.0).otherwise(a)


def angle_between(a: Column, b: Column) -> Column:
    """Of two orientations, in [0, 180]."""
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def reversed_angle(a: Column) -> Column:
    return F.when(a >= 180.0, a - 180.0).otherwise(a + 180.0)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def log_to_base(base: float, x: Column) -> Column:
    return F.log(float(base), x)


def half_open_radians(x: Column) -> Column:
    """In [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def direction(degrees: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(degrees)), F.sin(F.radians(degrees))


def quarter_turns(degrees: Column) -> Column:
    """Angular distance in units of right angles."""
    return degrees / 90.0


def order_key(dx: Column, dy: Column) -> Column:
    """A number in [0, 4) that orders directions as their angles do, by ratios only."""
    total = F.nullif(F.abs(dx) + F.abs(dy), F.lit(0.0))
    return F.when(dy >= 0, F.when(dx >= 0, dy / total).otherwise(1 - dx / total)).otherwise(F.when(dx < 0, 2 - dy / total).otherwise(3 + dx / total))


def crossing(x1, y1, x2, y2, x3, y3, x4, y4) -> tuple[Column, Column, Column]:
    """(t, u, parallel): positions on the lines through (x1, y1)-(x2, y2) and (x3, y3)-(x4, y4) where they meet."""
    dx, dy, ex, ey = x2 - x1, y2 - y1, x4 - x3, y4 - y3
    det = F.nullif(cross(dx, dy, ex, ey), F.lit(0.0))
    return cross(x3 - x1, y3 - y1, ex, ey) / det, cross(x3 - x1, y3 - y1, dx, dy) / det, det.isNull()


def nearest_position(px, py, x1, y1, x2, y2) -> Column:
    """In [0, 1] along the segment; 0 for a segment without length."""
    dx, dy = x2 - x1, y2 - y1
    return clamp(F.coalesce(dot(px - x1, py - y1, dx, dy) / F.nullif(dot(dx, dy, dx, dy), F.lit(0.0)), F.lit(0.0)), 0.0, 1.0)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    t = nearest_position(px, py, x1, y1, x2, y2)
    return distance(px, py, lerp(x1, x2, t), lerp(y1, y2, t))


def boxes_overlap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, margin: float = 0.0) -> Column:
    return (
        (F.least(ax1, ax2) - margin <= F.greatest(bx1, bx2)) & (F.greatest(ax1, ax2) + margin >= F.least(bx1, bx2))
        & (F.least(ay1, ay2) - margin <= F.greatest(by1, by2)) & (F.greatest(ay1, ay2) + margin >= F.least(by1, by2))
    )


def box_meets_circle(x1, y1, x2, y2, px, py, r) -> Column:
    dx, dy = px - F.greatest(F.least(x1, x2), F.least(px, F.greatest(x1, x2))), py - F.greatest(F.least(y1, y2), F.least(py, F.greatest(y1, y2)))
    return dx * dx + dy * dy <= r * r


def segment_meets_circle(x1, y1, x2, y2, px, py, r) -> Column:
    return point_segment_distance(px, py, x1, y1, x2, y2) <= r


def ring_edges(ring: Column) -> Column:
    """Edges (x1, y1, x2, y2) of a ring array<struct<x, y>> whose first point isn't repeated."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2")))


def ring_area(ring: Column) -> Column:
    """Signed; positive if counter-clockwise."""
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda a, e: a + cross(e["x1"], e["y1"], e["x2"], e["y2"])) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Of the area; the mean of the points where there is none."""
    area6, edges = F.nullif(ring_area(ring) * 6, F.lit(0.0)), ring_edges(ring)

    def along(c: str) -> Column:
        moment = F.aggregate(edges, F.lit(0.0), lambda a, e: a + (e[f"{c}1"] + e[f"{c}2"]) * cross(e["x1"], e["y1"], e["x2"], e["y2"]))
        mean = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[c]) / F.nullif(F.size(ring), F.lit(0))
        return F.coalesce(moment / area6, mean)

    return along("x"), along("y")


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """By the number of edges to the right of the point."""

    def crosses(e: Column) -> Column:
        above = (e["y1"] > py) != (e["y2"] > py)
        at = e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return F.when(above & (at > px), 1).otherwise(0)

    return F.aggregate(ring_edges(ring), F.lit(0), lambda a, e: a + crosses(e)) % 2 == 1


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    """On an edge or a corner of the ring."""

    def on(e: Column) -> Column:
        within = px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return within & (cross(e["x2"] - e["x1"], e["y2"] - e["y1"], px - e["x1"], py - e["y1"]) == 0)

    return F.exists(ring_edges(ring), on)


def inside_ring(px: Column, py: Column, ring: Column) -> Column:
    """In the ring and not on it."""
    return in_ring(px, py, ring) & ~on_ring(px, py, ring)


def in_rings(px: Column, py: Column, rings: Column) -> Column:
    """In a polygon of several rings array<ring>, which are outlines and holes: in an odd number of them."""
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + F.when(in_ring(px, py, ring), 1).otherwise(0)) % 2 == 1


def rings_area(rings: Column) -> Column:
    """Of an outline, the first ring, without its holes, the others."""
    areas = F.transform(rings, lambda ring: F.abs(ring_area(ring)))
    return 2 * F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0)) - F.aggregate(areas, F.lit(0.0), lambda a, b: a + b)


def decay(x: Column, kind: str, constant: float = 1.0, radius: float | None = None) -> Column:
    """constant: 1; pow: 1 - x^C; curve: two halves of a power curve; divide: (x + 1)^-C. pow and curve take x as a share of the radius."""
    if kind == "constant":
        return F.lit(1.0)
    if kind == "divide":
        return F.pow(x + 1.0, F.lit(-float(constant)))
    share = clamp(x / float(radius), 0.0, 1.0)
    if kind == "pow":
        return 1.0 - F.pow(share, F.lit(float(constant)))
    if kind == "curve":
        return F.when(share < 0.5, 1.0 - 0.5 * F.pow(2.0 * share, F.lit(float(constant)))).otherwise(0.5 * F.pow(2.0 - 2.0 * share, F.lit(float(constant))))
    raise ValueError(kind)


def equal_area_scale(n: int) -> float:
    """Radius of a regular n-gon with the area of the unit circle."""
    return math.sqrt(math.pi / (n * math.sin(math.pi / n) * math.cos(math.pi / n)))


def square_kilometres(x: Column) -> Column:
    return x * 1e-6


def hectares(x: Column) -> Column:
    return x * 1e-4


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of the 2 r + 1 pixels around one, r = ceil(3 sigma): they share the range of r / sigma on both sides evenly, each weighs the
    mean of ten samples of the bell curve in its share (the middle one ten in each half), and all add up to 1."""
    r = math.ceil(3 * sigma)
    step = r / sigma / (r + 0.5)
    raw = [sum(math.exp(-(((i - 0.5 + (k + 0.5) / n) * step) ** 2) / 2) for k in range(n)) / n for i in range(-r, r + 1) for n in (10 if i else 20,)]
    return [x / sum(raw) for x in raw]
