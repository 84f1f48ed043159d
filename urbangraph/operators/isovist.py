"""What can be seen from points: polygons of sight among obstacles, their area, the obstacles that bound them and what lies in them.

An origin's walls are the edges of obstacles in reach and field of view. Seen from it, a wall is a function of the angle, 1 / distance =
c cos + s sin; the nearest wall at each angle is the upper envelope of these, made by merging halves, for all origins of a batch at once: n
walls take log n merges. Walls may cross each other.

Defined results: an origin without coordinates has null for polygon, area and obstacles; repeated origins keep their rows; a null ring hides nothing; no
obstacles leave the whole circle; walls that run towards the origin hide nothing; of walls in one place the obstacle with the smaller id is seen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.lineage import cut
from urbangraph.operators import grid

RING = "array<struct<x:double,y:double>>"
#: Pieces of an outline that are narrower (radians) come from rounding.
NARROW = 1e-10


class Pieces:
    """Parts of walls, ordered by group and angle: group, from angle a to b, wall."""

    def __init__(self, group: np.ndarray, a: np.ndarray, b: np.ndarray, wall: np.ndarray):
        self.group, self.a, self.b, self.wall = group, a, b, wall

    def __len__(self) -> int:
        return len(self.group)

    def at(self, where: np.ndarray) -> Pieces:
        return Pieces(self.group[where], self.a[where], self.b[where], self.wall[where])


def nearness(lines: np.ndarray, wall: np.ndarray, angle: np.ndarray) -> np.ndarray:
    return lines[wall, 0] * np.cos(angle) + lines[wall, 1] * np.sin(angle)


def merged(one: Pieces, two: Pieces, lines: np.ndarray) -> Pieces:
    """The nearer of both at every angle, in each group; walls of `one` where they are equally near."""
    ends = np.concatenate([one.a, one.b, two.a, two.b])
    group = np.concatenate([one.group, one.group, two.group, two.group])
    order = np.lexsort((ends, group))
    group, ends = group[order], ends[order]

    def covering(own: Pieces, first: int) -> np.ndarray:
        """The wall of `own` after each end; -1 where there is none."""
        begun = np.where((order >= first) & (order < first + len(own)), order - first, -1)
        begun = np.maximum.accumulate(begun)
        there = (begun >= 0) & (own.group[begun] == group) & (own.b[begun] > ends) if len(own) else np.zeros(len(ends), bool)
        return np.where(there, own.wall[begun], -1) if len(own) else np.full(len(ends), -1)

    u, v = covering(one, 0), covering(two, 2 * len(one))
    real = np.flatnonzero((group[:-1] == group[1:]) & (ends[:-1] < ends[1:]) & ((u[:-1] >= 0) | (v[:-1] >= 0)))
    group, a, b, u, v = group[real], ends[real], ends[real + 1], u[real], v[real]
    apart = lines[u] - lines[v]
    meet = np.mod(np.arctan2(-apart[:, 0], apart[:, 1]), np.pi)
    meet = np.where(meet <= a, meet + np.pi, meet)
    cut = np.flatnonzero((u >= 0) & (v >= 0) & (meet > a) & (meet < b))
    place = np.argsort(np.concatenate([np.arange(len(a)), cut]), kind="stable")
    again = np.concatenate([np.arange(len(a)), cut])[place]
    second = (place >= len(a))
    split = np.zeros(len(a), bool)
    split[cut] = True
    group, u, v = group[again], u[again], v[again]
    a, b = np.where(second, meet[again], a[again]), np.where(split[again] & ~second, meet[again], b[again])
    middle = (a + b) / 2
    near = nearness(lines, u, middle) >= nearness(lines, v, middle) * (1 - 1e-12)
    return joined(Pieces(group, a, b, np.where((v < 0) | (near & (u >= 0)), u, v)))


def joined(own: Pieces) -> Pieces:
    """Adjoining pieces of one wall as one."""
    if not len(own):
        return own
    new = np.ones(len(own), bool)
    new[1:] = (own.group[1:] != own.group[:-1]) | (own.wall[1:] != own.wall[:-1]) | (own.a[1:] != own.b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    return Pieces(own.group[first], own.a[first], own.b[last], own.wall[first])


def outlines(walls: np.ndarray, owner: np.ndarray, origins: int, outer: float, span: float, sides: int) -> tuple[Pieces, np.ndarray]:
    """What bounds the sight of each origin at angles 0 to span, and c and s of all walls; the walls after len(walls) are the circle's sides.
    walls: x1, y1, x2, y2 seen from the owner, ordered by it."""
    x1, y1, x2, y2 = walls.T
    turn = x1 * y2 - y1 * x2
    back = turn < 0
    x1, y1, x2, y2 = np.where(back, x2, x1), np.where(back, y2, y1), np.where(back, x1, x2), np.where(back, y1, y2)
    size = np.hypot(x1, y1) * np.hypot(x2, y2)
    open_to = np.flatnonzero(np.abs(turn) > 1e-12 * np.maximum(size, 1e-300))
    with np.errstate(divide="ignore", invalid="ignore"):
        lines = np.stack([(y2 - y1) / np.abs(turn), (x1 - x2) / np.abs(turn)], 1)
    a, b = (np.mod(np.arctan2(y[open_to], x[open_to]), 2 * np.pi) for x, y in ((x1, y1), (x2, y2)))
    over = b <= a
    a, b = np.concatenate([a, np.zeros(int(over.sum()))]), np.concatenate([np.where(over, 2 * np.pi, b), b[over]])
    wall = np.concatenate([open_to, open_to[over]])
    b = np.minimum(b, span)
    own = Pieces(owner[wall], a, b, wall).at(np.lexsort((a, wall)))
    own = own.at(own.b > own.a)
    rank = np.arange(len(own)) - np.searchsorted(own.group, own.group)
    while len(own) and rank.max() > 0:
        width = int(rank.max()) // 2 + 1
        halves = Pieces(own.group * width + rank // 2, own.a, own.b, own.wall)
        own = merged(halves.at(rank % 2 == 0), halves.at(rank % 2 == 1), lines)
        rank = own.group % width
        own.group = own.group // width
    part = span / sides
    middle = part * (np.arange(sides) + 0.5)
    lines = np.concatenate([lines, np.stack([np.cos(middle), np.sin(middle)], 1) / (outer * math.cos(part / 2))])
    edge = np.arange(sides)
    circle = Pieces(np.repeat(np.arange(origins), sides), np.tile(part * edge, origins), np.tile(part * (edge + 1), origins), np.tile(len(walls) + edge, origins))
    found = merged(own, circle, lines)
    return joined(found.at(found.b - found.a > NARROW)), lines


def in_view(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, fov: float, direction: float) -> Column:
    """Whether any of the segment lies in the field of view around direction (degrees)."""
    if fov >= 360:
        return F.lit(True)
    first, span = math.radians(direction - fov / 2), math.radians(fov)
    ax, ay, bx, by = x1 - px, y1 - py, x2 - px, y2 - py
    turn = G.cross(ax, ay, bx, by)
    start = F.pmod(F.when(turn >= 0, F.atan2(ay, ax)).otherwise(F.atan2(by, bx)) - first, F.lit(2 * math.pi))
    return (start <= span + 1e-9) | (start + F.atan2(F.abs(turn), G.dot(ax, ay, bx, by)) >= 2 * math.pi - 1e-9)


def isovists(origins: DataFrame, obstacles: DataFrame, distance: float, fov: float = 360.0, direction: float = 0.0, sides: int = 64) -> DataFrame:
    """pt_id, x, y, polygon (clockwise), area, obstacles (ids in sight, ascending). obstacles: group_id, ring, where rings of one id are the outlines and holes of one
    obstacle; those around the origin don't hide anything."""
    return seen_by(origins, sights(origins, obstacles, distance, fov, direction, sides))


def seen_by(origins: DataFrame, sights: DataFrame) -> DataFrame:
    """The sights of the places that origins (pt_id, x, y) are at."""
    return origins.select(F.col("pt_id").cast("long").alias("pt_id"), "x", "y").join(sights.hint("merge"), ["x", "y"], "left").select("pt_id", "x", "y", *(c for c in sights.columns if c not in ("x", "y")))


def distinct_obstacles(obstacles: DataFrame) -> DataFrame:
    """group_id, ring: of obstacles with the same rings the one with the smallest id, which is the one seen."""
    whole = obstacles.where(F.size("ring") > 1).groupBy("group_id").agg(F.sort_array(F.collect_list("ring")).alias("rings"))
    return whole.groupBy("rings").agg(F.min(F.struct("group_id")).alias("o")).select("o.group_id", F.explode("rings").alias("ring"))


def sights(origins: DataFrame, obstacles: DataFrame, distance: float, fov: float = 360.0, direction: float = 0.0, sides: int = 64) -> DataFrame:
    """x, y, polygon, area, obstacles (see isovists) of each place that has origins, once."""
    outer = distance * G.equal_area_scale(sides)
    first, span = math.radians(direction - fov / 2), math.radians(min(fov, 360.0))
    spots = grid.places(origins.where(~F.isnan("x") & ~F.isnan("y"))).select("x", "y")
    own = grid.boxed(spots, "x", "y", "x", "y", outer)
    cell = max(distance, 1.0)
    rings = cut(distinct_obstacles(obstacles))
    corners = {f"b{c}{i}": f(F.col("ring")[c]) for c in "xy" for i, f in ((1, F.array_min), (2, F.array_max))}
    here = grid.boxed(spots, "x", "y", "x", "y")
    inside = grid.overlapping(here, rings.withColumns(corners), cell).where(G.in_ring(F.col("x"), F.col("y"), F.col("r_ring")))
    inside = inside.groupBy("x", "y", F.col("r_group_id").alias("group_id")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")
    edges = rings.select("group_id", F.explode(G.ring_edges(F.col("ring"))).alias("e")).select("group_id", "e.*")
    x, y, *wall = (F.col(c) for c in ("x", "y", "r_x1", "r_y1", "r_x2", "r_y2"))
    near = grid.overlapping(own, grid.boxed(edges, "x1", "y1", "x2", "y2"), cell).where(G.segment_meets_circle(*wall, x, y, outer) & in_view(x, y, *wall, fov, direction))
    near = near.select("x", "y", F.struct(F.col("r_group_id").alias("group_id"), *(c.alias(n) for c, n in zip(wall, ("x1", "y1", "x2", "y2"), strict=True))).alias("wall"))
    a, b = near.alias("a"), inside.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("x", "y")]
    near = a.join(b.hint("merge"), [*same, F.col("a.wall.group_id").eqNullSafe(F.col("b.group_id"))], "left_anti")
    both = spots.select("x", "y", F.lit(None).cast(near.schema["wall"].dataType).alias("wall")).unionByName(near)
    ready = both.groupBy("x", "y").agg(F.sort_array(F.collect_list("wall")).alias("walls"))

    def kernel(batches):
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            lists = batch.column("walls")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            x1, y1, x2, y2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
            c, s = math.cos(first), math.sin(first)
            turned = [(dx * c + dy * s, dy * c - dx * s) for dx, dy in ((x1 - x[owner], y1 - y[owner]), (x2 - x[owner], y2 - y[owner]))]
            found, lines = outlines(np.stack([*turned[0], *turned[1]], 1), owner, batch.num_rows, outer, span, sides)
            ra, rb = 1 / nearness(lines, found.wall, found.a), 1 / nearness(lines, found.wall, found.b)
            area = np.bincount(found.group, ra * rb * np.sin(found.b - found.a) / 2, batch.num_rows)
            px = np.stack([ra * np.cos(found.a + first), rb * np.cos(found.b + first)], 1) + x[found.group][:, None]
            py = np.stack([ra * np.sin(found.a + first), rb * np.sin(found.b + first)], 1) + y[found.group][:, None]
            at = np.searchsorted(found.group, np.arange(batch.num_rows + 1))
            ids = flat.field("group_id").to_pylist()
            polygons, seen = [], []
            for i in range(batch.num_rows):
                own = slice(at[i], at[i + 1])
                polygons.append(corners_of(px[own].ravel(), py[own].ravel(), outer, None if fov >= 360 else (x[i], y[i])))
                hit = {ids[w] for w in found.wall[own].tolist() if w < len(ids)}
                seen.append(sorted(h for h in hit if h is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("y"), pa.array(polygons, pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()}))), pa.array(area), pa.array(seen, pa.list_(pa.int64()))],
                ["x", "y", "polygon", "area", "obstacles"],
            )

    ready = ready.select("x", "y", F.transform("walls", lambda w: w.withField("group_id", w["group_id"].cast("long"))).alias("walls"))
    return ready.mapInArrow(kernel, f"x double, y double, polygon {RING}, area double, obstacles array<long>")


def corners_of(px: np.ndarray, py: np.ndarray, size: float, eye: tuple[float, float] | None) -> list[dict]:
    """Clockwise, each corner once; with the origin itself if the view isn't a whole turn."""
    apart = np.hypot(px - np.roll(px, 1), py - np.roll(py, 1)) > 1e-9 * size
    if eye:
        apart[0] = True
    ring = list(zip(px[apart].tolist(), py[apart].tolist(), strict=True))
    return [{"x": a, "y": b} for a, b in ([eye] if eye else []) + ring][::-1]


def seen_from(views: DataFrame) -> DataFrame:
    """Views with the boxes of their polygons; those without one see nothing."""
    box = {f"b{c}{i}": f(F.col("polygon")[c]) for c in "xy" for i, f in ((1, F.array_min), (2, F.array_max))}
    return views.select("pt_id", "x", "y", "polygon").where(F.size("polygon") > 2).withColumns(box)


def visible_points(views: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """pt_id, seen_id of the points (pt_id, x, y) inside each view's polygon. distance: about how far views reach."""
    near = grid.overlapping(seen_from(views), grid.boxed(points.select("pt_id", "x", "y"), "x", "y", "x", "y"), max(distance, 1.0))
    return near.where(G.in_ring(F.col("r_x"), F.col("r_y"), F.col("polygon"))).select("pt_id", F.col("r_pt_id").alias("seen_id"))


def points_in_sight(views: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """pt_id, n of the points (pt_id, x, y) inside each view's polygon; those at one place are held against it once."""
    near = grid.overlapping(seen_from(views), grid.boxed(grid.places(points), "x", "y", "x", "y"), max(distance, 1.0))
    return near.where(G.in_ring(F.col("r_x"), F.col("r_y"), F.col("polygon"))).groupBy("pt_id").agg(F.sum("r_n_points").alias("n"))


def visible_regions(views: DataFrame, regions: DataFrame, distance: float) -> DataFrame:
    """pt_id, seen_id of the regions (region_id, ring) that hold the origin, have a corner in the view or an edge that crosses its outline, each once."""
    cell = max(distance, 1.0)
    seeing, rings = seen_from(views), regions.select("region_id", "ring").where(F.size("ring") > 1)
    edges = rings.select("region_id", F.explode(G.ring_edges(F.col("ring"))).alias("e")).select("region_id", "e.*")
    near = grid.overlapping(seeing, grid.boxed(edges, "x1", "y1", "x2", "y2"), cell)

    def meets(e):
        t, u, _ = G.crossing(F.col("r_x1"), F.col("r_y1"), F.col("r_x2"), F.col("r_y2"), e["x1"], e["y1"], e["x2"], e["y2"])
        return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))

    touched = near.where(G.in_ring(F.col("r_x1"), F.col("r_y1"), F.col("polygon")) | F.exists(G.ring_edges(F.col("polygon")), meets)).select("pt_id", F.col("r_region_id").alias("seen_id"))
    box = {f"b{c}{i}": f(F.col("ring")[c]) for c in "xy" for i, f in ((1, F.array_min), (2, F.array_max))}
    here = grid.boxed(seeing.select("pt_id", "x", "y"), "x", "y", "x", "y")
    around = grid.overlapping(here, rings.withColumns(box), cell).where(G.in_ring(F.col("x"), F.col("y"), F.col("r_ring"))).select("pt_id", F.col("r_region_id").alias("seen_id"))
    return touched.union(around).distinct()
