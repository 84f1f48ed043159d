"""Spatial joins as equi-joins on grid cells. Catalyst has no spatial index; a box condition alone compares all pairs.

Each shape is listed under all cells that its box touches, so a pair may meet in several cells; it counts only in the cell that
holds the lower left corner of the boxes' overlap, which needs no shuffle to remove duplicates.

Spark takes a table that was exploded for as small as the files it came from, and would broadcast it; the joins here merge instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def boxed(df: DataFrame, x1: str, y1: str, x2: str, y2: str, margin: float = 0.0) -> DataFrame:
    """With the corners bx1, by1, bx2, by2 of its box."""
    low, high = (lambda a, b: F.least(F.col(a), F.col(b)) - margin), (lambda a, b: F.greatest(F.col(a), F.col(b)) + margin)
    return df.withColumns({"bx1": low(x1, x2), "by1": low(y1, y2), "bx2": high(x1, x2), "by2": high(y1, y2)})


def dealt(df: DataFrame, size: float) -> DataFrame:
    """A row for each cell (gx, gy) of the box."""
    across = F.sequence(cell(F.col("bx1"), size), cell(F.col("bx2"), size))
    down = F.sequence(cell(F.col("by1"), size), cell(F.col("by2"), size))
    return df.withColumn("gx", F.explode(across)).withColumn("gy", F.explode(down))


def overlapping(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of rows of boxed tables whose boxes overlap, once each. The columns of right get the prefix r_."""
    a = dealt(left, size)
    b = dealt(right, size)
    b = b.select(*(F.col(c) if c in ("gx", "gy") else F.col(c).alias(f"r_{c}") for c in b.columns))
    meet = (F.col("bx1") <= F.col("r_bx2")) & (F.col("bx2") >= F.col("r_bx1")) & (F.col("by1") <= F.col("r_by2")) & (F.col("by2") >= F.col("r_by1"))
    here = (F.col("gx") == cell(F.greatest("bx1", "r_bx1"), size)) & (F.col("gy") == cell(F.greatest("by1", "r_by1"), size))
    box = ("bx1", "by1", "bx2", "by2")
    return a.join(b.hint("merge"), ["gx", "gy"]).where(meet & here).drop("gx", "gy", *box, *(f"r_{c}" for c in box))


def places(points: DataFrame, *aggregates: Column) -> DataFrame:
    """x, y and the aggregates of each place that points (x, y) have, once; those with a null coordinate are left out."""
    return points.where("x is not null and y is not null").groupBy("x", "y").agg(*(aggregates or (F.count(F.lit(1)).alias("n_points"),)))


def points_in_shapes(points: DataFrame, shapes: DataFrame, shape: str, corners: tuple[Column, Column, Column, Column], inside) -> DataFrame:
    """region_id, pt_id of the points (pt_id, x, y) for which inside(x, y, shape) holds. shapes: region_id and a column shape, whose box has the given corners. Each place
    is held against each outline once; points and regions that share them follow by joins."""
    outlines = shapes.select(F.col(shape).alias("shape")).distinct().select("shape", *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))
    at = places(points).select("x", "y")
    near = overlapping(boxed(at, "x", "y", "x", "y"), boxed(outlines, "x1", "y1", "x2", "y2"), 100.0)
    met = near.where(inside(F.col("x"), F.col("y"), F.col("r_shape"))).select("x", "y", F.col("r_shape").alias("shape"))
    of = met.join(shapes.select("region_id", F.col(shape).alias("shape")).hint("merge"), "shape").select("region_id", "x", "y")
    return of.join(points.select("pt_id", "x", "y").hint("merge"), ["x", "y"]).select("region_id", "pt_id")


def line_pairs(left: DataFrame, right: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    return overlapping(boxed(left, "x1", "y1", "x2", "y2", margin), boxed(right, "x1", "y1", "x2", "y2"), size)


def points_near_lines(points: DataFrame, lines: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """Candidates: points (pt_id, x, y) and lines (r_line_id, ...) whose box comes within radius."""
    return overlapping(boxed(points, "x", "y", "x", "y", radius), boxed(lines, "x1", "y1", "x2", "y2"), size or max(radius, 1.0))
