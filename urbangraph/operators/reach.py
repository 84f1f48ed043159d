"""What lies within reach of lines: counts, lengths, depths, and distances to and decayed sums of attractions.

Limits of several kinds hold for one path (see multidistance). Walking goes from and to the middle of lines. Empty tables give empty results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.functions import normalize as N
from urbangraph.lineage import cut
from urbangraph.operators import axial, grid, multidistance, segments
from urbangraph.operators.frontier import first_visits, relax
from urbangraph.operators.multidistance import line_steps
from urbangraph.radii import Radius


def walks(at: DataFrame, lines: DataFrame, weight: str = "length") -> DataFrame:
    """src, dst, cost between the crossings of each line; neighbours along the line are enough, as costs add up."""
    from pyspark.sql import Window

    along = Window.partitionBy("line_id").orderBy("t", "crossing")
    nexts = at.join(lines.select("line_id", F.col(weight).alias("w")), "line_id").withColumn("to", F.lead("crossing").over(along)).withColumn("cost", (F.lead("t").over(along) - F.col("t")) * F.col("w")).where("to is not null")
    one = nexts.select(F.col("crossing").alias("src"), F.col("to").alias("dst"), "cost")
    return cut(one.union(one.select(F.col("dst"), F.col("src"), "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost")))


def line_depths(g: dict[str, DataFrame], radius: Radius, kind: str) -> DataFrame:
    """origin, line_id, d: the least cost from each line to each line by one kind of distance, on paths within all limits."""
    others = [k for k in radius.limits() if k != kind]
    if others or kind not in ("steps", "straight", "walking"):
        return multidistance.reached(g, multidistance.from_lines(g), kind, radius).withColumnRenamed("target", "line_id")
    lines, limit = g["lines"], radius.limits().get(kind)
    if kind == "straight":
        mid = lines.select("line_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
        near = grid.overlapping(grid.boxed(mid, "x", "y", "x", "y", limit), grid.boxed(mid, "x", "y", "x", "y"), max(limit, 1.0))
        return near.withColumn("d", G.distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).where(F.col("d") <= limit).select(F.col("line_id").alias("origin"), F.col("r_line_id").alias("line_id"), "d")
    lines, at = cut(lines), cut(g["line_crossings"])
    itself = lines.select(F.col("line_id").alias("origin"), "line_id", F.lit(0.0).alias("d"))
    if kind == "steps":
        seeds = lines.select(F.col("line_id").alias("origin"), F.col("line_id").alias("node"))
        return first_visits(seeds, line_steps(at), limit).withColumnRenamed("node", "line_id")
    half = F.abs(F.col("t") - 0.5)
    here = cut(at.join(lines.select("line_id", "length"), "line_id").select("line_id", "crossing", (half * F.col("length")).alias("leg")))
    seeds = here.select(F.col("line_id").alias("origin"), F.col("crossing").alias("node"), F.col("leg").alias("d"))
    reached = relax(seeds, walks(at, lines), limit)
    found = reached.join(here, reached["node"] == here["crossing"]).select("origin", "line_id", (F.col("d") + F.col("leg")).alias("d"))
    found = found if limit is None else found.where(F.col("d") <= limit)
    return found.where("origin <> line_id").union(itself).groupBy("origin", "line_id").agg(F.min("d").alias("d"))


def reached_lines(g: dict[str, DataFrame], radius: Radius) -> DataFrame:
    """origin, line_id of all lines that one path within all limits reaches; without a limit those that steps do."""
    kinds = list(radius.limits())
    found = line_depths(g, radius, kinds[0] if kinds else "steps") if len(kinds) < 2 else multidistance.reached(g, multidistance.from_lines(g), None, radius).withColumnRenamed("target", "line_id")
    return found.select("origin", "line_id")


def hull_area(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the convex hull of one origin's end points (a monotone chain)."""
    pts = sorted(set(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    return pd.DataFrame({"line_id": [pdf["origin"].iloc[0]], "reach_area": [abs(area)]})


def reach(g: dict[str, DataFrame], radius: Radius, area: bool = True) -> DataFrame:
    """line_id, reach_count (its own line included), reach_length and reach_area (of the hull of the lines reached; of the circle if the
    only limit is straight)."""
    lines = g["lines"]
    straight = list(radius.limits()) == ["straight"]
    found = reached_lines(g, radius)
    joined = (found if straight or not area else cut(found)).join(lines, "line_id")
    out = joined.groupBy(F.col("origin").alias("line_id")).agg(F.count(F.lit(1)).alias("reach_count"), F.sum("length").alias("reach_length"))
    if not area:
        return out
    if straight:
        return out.withColumn("reach_area", F.lit(math.pi * radius.straight**2))
    ends = joined.select("origin", F.col("x1").alias("x"), F.col("y1").alias("y")).union(joined.select("origin", "x2", "y2")).distinct()
    return out.join(ends.groupBy("origin").applyInPandas(hull_area, "line_id long, reach_area double"), "line_id")


def network_integration(g: dict[str, DataFrame], radius: Radius = Radius()) -> DataFrame:  # noqa: B008
    """line_id, node_count, total_depth (the least steps on paths within all limits), integration."""
    depths = line_depths(g, radius, "steps")
    sums = depths.groupBy(F.col("origin").alias("line_id")).agg(F.count(F.lit(1)).alias("node_count"), F.sum("d").alias("total_depth"))
    return sums.withColumn("integration", N.network_integration(F.col("node_count"), F.col("total_depth")))


def junction_scores(g: dict[str, DataFrame], scores: DataFrame) -> DataFrame:
    """x, y, score: the mean of the scores (line_id, integration) of the lines that meet at each point."""
    return g["line_crossings"].join(scores, "line_id").groupBy("crossing").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.avg("integration").alias("score")).drop("crossing")


def segment_depths(lines: DataFrame, radius: Radius) -> DataFrame:
    """origin, line_id, d: the least turns in degrees from each segment to each, over all paths within all limits."""
    radius.only("depths by turns", "walking", "steps", "angular")
    metrics = multidistance.needed("angular", radius)
    edges = segments.states(lines).select("src", "dst", multidistance.units(F.col("walk")).alias("walking"), F.lit(1).cast("long").alias("steps"), multidistance.units(F.col("turn")).alias("angular"))
    seeds = lines.select(F.col("line_id").alias("origin"), F.explode(F.array(F.col("line_id") * 2, F.col("line_id") * 2 + 1)).alias("node"), *(F.lit(0).cast("long").alias(m) for m in metrics))
    found = multidistance.search(seeds, cut(edges), metrics, radius)
    return found.groupBy("origin", F.expr("node div 2").alias("line_id")).agg((F.min("angular") / multidistance.SCALE).alias("d"))


def depth_sums(depths: DataFrame, lines: DataFrame) -> DataFrame:
    """line_id, node_count, total_depth (in right angles), total_weight and total_depth_weight (by length; the origin is in the count only) of
    depths (origin, line_id, d in degrees)."""
    joined = depths.join(segments.described(lines).select("line_id", "length"), "line_id")
    other = F.col("origin") != F.col("line_id")
    return joined.groupBy(F.col("origin").alias("line_id")).agg(
        F.count(F.lit(1)).alias("node_count"),
        (F.sum("d") / 90.0).alias("total_depth"),
        F.coalesce(F.sum(F.when(other, F.col("length"))), F.lit(0.0)).alias("total_weight"),
        (F.coalesce(F.sum(F.when(other, F.col("length") * F.col("d"))), F.lit(0.0)) / 90.0).alias("total_depth_weight"),
    )


def straight_pairs(origins: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """Pairs and their d within radius (both x, y and what they have besides, the columns of targets as r_)."""
    near = grid.overlapping(grid.boxed(origins, "x", "y", "x", "y", radius), grid.boxed(targets, "x", "y", "x", "y"), max(radius, 1.0))
    return near.withColumn("d", G.distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).where(F.col("d") <= radius)


def attraction_distance_straight(origins: DataFrame, attractions: DataFrame, radius: float) -> DataFrame:
    """pt_id, distance to the nearest attraction within radius, -1 if there is none."""
    least = straight_pairs(grid.places(origins), grid.places(attractions), radius).groupBy("x", "y").agg(F.min("d").alias("d"))
    return origins.select("pt_id", "x", "y").join(least.hint("merge"), ["x", "y"], "left").select("pt_id", F.coalesce("d", F.lit(-1.0)).alias("distance"))


def attraction_reach_straight(origins: DataFrame, attractions: DataFrame, radius: float, kind: str = "constant", constant: float = 1.0) -> DataFrame:
    """pt_id, score: the sum of value times decay over attractions (pt_id, x, y, value > 0) within radius."""
    near = straight_pairs(grid.places(origins), grid.places(attractions.where(F.col("value") > 0), F.sum("value").alias("value")), radius)
    sums = near.groupBy("x", "y").agg(F.sum(F.col("r_value") * G.decay(F.col("d"), kind, constant, radius)).alias("score"))
    return origins.select("pt_id", "x", "y").join(sums.hint("merge"), ["x", "y"], "left").select("pt_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def attraction_lines(g: dict[str, DataFrame], attractions: DataFrame, kind: str, limit: float | None = None, together: bool = True) -> DataFrame:
    """origin, line_id, d from attractions to lines along the network; together: from all at once, as origin 0.

    Walking includes the way from the attraction to its nearest line; steps count line changes."""
    lines, at = cut(g["lines"]), cut(g["line_crossings"])
    near = cut(axial.nearest_line(attractions, lines).withColumn("origin", F.lit(0).cast("long") if together else F.col("pt_id")))
    if kind == "steps":
        seeds = near.select("origin", F.col("line_id").alias("node"), F.lit(0.0).alias("d"))
        return relax(seeds, line_steps(at), limit).withColumnRenamed("node", "line_id")
    if kind == "walking":
        here = cut(at.join(lines.select("line_id", "length"), "line_id"))
        seeds = near.withColumnRenamed("t", "pt").join(here, "line_id").select("origin", F.col("crossing").alias("node"), (F.col("d") + F.abs(F.col("t") - F.col("pt")) * F.col("length")).alias("d"))
        reached = relax(seeds, walks(at, lines), limit)
        on = reached.join(here, reached["node"] == here["crossing"]).select("origin", "line_id", (F.col("d") + F.abs(F.col("t") - 0.5) * F.col("length")).alias("d"))
        own = near.join(lines.select("line_id", "length"), "line_id").select("origin", "line_id", (F.col("d") + F.abs(F.col("t") - 0.5) * F.col("length")).alias("d"))
        every = on.union(own)
        return (every if limit is None else every.where(F.col("d") <= limit)).groupBy("origin", "line_id").agg(F.min("d").alias("d"))
    raise ValueError(f"no attraction paths by {kind}")


def attraction_distance(g: dict[str, DataFrame], attractions: DataFrame, kind: str, limit: float | None = None) -> DataFrame:
    """line_id, distance to the nearest attraction by one relaxation from all attractions at once; -1 beyond the limit. Angular and axmeter, and
    other targets or limits: multidistance.attraction_distance."""
    if kind not in ("steps", "walking"):
        return multidistance.attraction_distance(g, attractions, kind, Radius(**({} if limit is None else {kind: limit}))).withColumnRenamed("target", "line_id")
    found = attraction_lines(g, attractions, kind, limit)
    return g["lines"].select("line_id").join(found, "line_id", "left").select("line_id", F.coalesce("d", F.lit(-1.0)).alias("distance"))


def attraction_reach(g: dict[str, DataFrame], attractions: DataFrame, kind: str, limit: float | None = None, decay: str = "constant", constant: float = 1.0) -> DataFrame:
    """line_id, score: for each attraction (with value) its best score at the line, summed. Angular and axmeter, polygons, and other targets
    or limits: multidistance.attraction_reach."""
    if kind not in ("steps", "walking"):
        return multidistance.attraction_reach(g, attractions, kind, Radius(**({} if limit is None else {kind: limit})), decay, constant).withColumnRenamed("target", "line_id")
    valued = attractions.where(F.col("value") > 0)
    found = attraction_lines(g, valued, kind, limit, together=False)
    scale = None if limit is None else limit + (kind == "steps")
    scored = found.join(valued.select(F.col("pt_id").alias("origin"), "value"), "origin").withColumn("s", F.col("value") * G.decay(F.col("d"), decay, constant, scale))
    sums = scored.groupBy("line_id").agg(F.sum("s").alias("score"))
    return g["lines"].select("line_id").join(sums, "line_id", "left").select("line_id", F.coalesce("score", F.lit(0.0)).alias("score"))
