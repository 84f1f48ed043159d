"""The axial graph: where lines cross or touch, once an unlink hasn't removed it, and what lies nearest to points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.lineage import cut
from urbangraph.operators import grid

#: Positions on a line may miss its ends by so much; shorter lines have no crossings.
EPSILON, SHORTEST = 1e-5, 0.01
CELL = 250.0
PAIR = ("x1", "y1", "x2", "y2", "r_x1", "r_y1", "r_x2", "r_y2")


def with_length(lines: DataFrame) -> DataFrame:
    return lines.withColumn("length", G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def crossing_pairs(left: DataFrame, right: DataFrame | None = None, cell: float = CELL) -> DataFrame:
    """line_a, line_b, x, y, t_a, t_b of all crossings of two layers, or of one with itself (line_a < line_b). An end that both share is
    exactly that point; parallel lines cross nowhere else."""
    same = right is None
    columns = ("line_id", "x1", "y1", "x2", "y2")
    long = [with_length(d.select(*columns)).where(F.col("length") >= SHORTEST).drop("length") for d in (left, left if same else right)]
    pairs = grid.line_pairs(long[0], long[1], cell)
    if same:
        pairs = pairs.where(F.col("line_id") < F.col("r_line_id"))
    ends = [(F.lit(float(i)), F.lit(float(j)), F.col(f"x{i + 1}"), F.col(f"y{i + 1}"), (F.col(f"x{i + 1}") == F.col(f"r_x{j + 1}")) & (F.col(f"y{i + 1}") == F.col(f"r_y{j + 1}"))) for i in (0, 1) for j in (0, 1)]
    t, u, parallel = G.crossing(*map(F.col, PAIR))
    shared = F.lit(None).cast("struct<t:double,u:double,x:double,y:double>")
    for ti, uj, x, y, here in reversed(ends):
        shared = F.when(here, F.struct(ti.alias("t"), uj.alias("u"), x.alias("x"), y.alias("y"))).otherwise(shared)
    inside = ~parallel & t.between(-EPSILON, 1 + EPSILON) & u.between(-EPSILON, 1 + EPSILON)
    t0, u0 = G.clamp(t, 0.0, 1.0), G.clamp(u, 0.0, 1.0)
    x, y = G.lerp(F.col("x1"), F.col("x2"), t0), G.lerp(F.col("y1"), F.col("y2"), t0)
    inner = F.when(inside, F.struct(t0.alias("t"), u0.alias("u"), x.alias("x"), y.alias("y")))
    found = pairs.withColumn("at", F.coalesce(shared, inner)).where(F.col("at").isNotNull())
    return found.select(F.col("line_id").alias("line_a"), F.col("r_line_id").alias("line_b"), "at.x", "at.y", F.col("at.t").alias("t_a"), F.col("at.u").alias("t_b"))


def without_unlinks(crossings: DataFrame, unlinks: DataFrame | None) -> DataFrame:
    """crossings without those that unlinks (pt_id, x, y) take: in the order of pt_id each unlink takes the nearest crossing left,
    not at an end of its first line. No unlinks or no crossings: nothing changes."""
    pair = ("line_a", "line_b")
    held = unlinks and taken(unlinks, crossings.where(~F.col("t_a").isin(0.0, 1.0)).select(*pair, "x", "y"), pair)
    return crossings if held is None else crossings.join(held, list(pair), "left_anti")


def without_unlinked_points(cuts: DataFrame, unlinks: DataFrame | None, most: float) -> DataFrame:
    """cuts without those in the points that unlinks (pt_id, x, y) take: in the order of pt_id each takes the nearest point with cuts that is
    left and nearer than most, and all cuts there go, those at ends of lines too. Equally near points: the least x, then y."""
    held = unlinks and taken(unlinks, cuts.select("x", "y").distinct(), ("x", "y"), most)
    return cuts if held is None else cuts.join(held, ["x", "y"], "left_anti")


def taken(unlinks: DataFrame, places: DataFrame, key: tuple[str, ...], most: float | None = None) -> DataFrame | None:
    """The keys of the places (key columns, x, y) that unlinks take in turn; null if there are none to take. In rounds: each open unlink asks for
    the nearest place that none before it in order holds, a place goes to the first that asks, and whoever loses one that way is open
    again. That ends with the same as taking turns. Unlinks with a null coordinate take nothing."""
    everyone = cut(unlinks.where("x is not null and y is not null").select("pt_id", F.col("x").alias("ux"), F.col("y").alias("uy")))
    open_, held = everyone, None
    places = cut(places.select(*(F.col(c).alias(f"k_{c}") for c in key), "x", "y"))
    names = [f"k_{c}" for c in key]
    while open_.take(1):
        free = places.withColumn("holder", F.lit(None).cast("long")) if held is None else places.join(held, names, "left")
        asked = nearest_place(open_, free, names, most).select("pt_id", *names)
        claims = asked if held is None else asked.union(held.select(F.col("holder").alias("pt_id"), *names))
        new = cut(claims.groupBy(*names).agg(F.min("pt_id").alias("holder")))
        settled = asked.select("pt_id") if held is None else asked.select("pt_id").union(held.select("holder"))
        open_ = cut(settled.distinct().join(new.select(F.col("holder").alias("pt_id")), "pt_id", "left_anti").join(everyone, "pt_id"))
        held = new
    return None if held is None else held.select(*(F.col(f"k_{c}").alias(c) for c in key))


def nearest_place(unlinks: DataFrame, places: DataFrame, names: list[str], most: float | None) -> DataFrame:
    """pt_id and the key of the nearest place without a holder of a smaller pt_id, nearer than most, searched in rings, each four times as wide,
    until one is found within the ring."""
    radius, limit, found = 30.0, most or float("inf"), None
    todo = unlinks
    bounds = places.agg(F.max(F.abs("x")), F.max(F.abs("y")), F.count(F.lit(1))).first()
    if not bounds[2]:
        return places.select(F.lit(0).cast("long").alias("pt_id"), *names, F.lit(0.0).alias("d"))  # no rows
    far = unlinks.agg(F.max(F.abs("ux")), F.max(F.abs("uy"))).first()
    whole = 2.0 * (max(bounds[0], bounds[1]) + max(far[0] or 0.0, far[1] or 0.0)) + radius
    while True:
        r = min(radius, limit, whole)
        a = grid.boxed(todo, "ux", "uy", "ux", "uy", r)
        b = grid.boxed(places, "x", "y", "x", "y")
        d = G.distance(F.col("ux"), F.col("uy"), F.col("r_x"), F.col("r_y"))
        near = grid.overlapping(a, b, max(r, 1.0)).withColumn("d", d).where((F.col("d") <= r) & (F.col("d") < limit) & (F.col("r_holder").isNull() | (F.col("r_holder") > F.col("pt_id"))))
        best = near.groupBy("pt_id").agg(F.min(F.struct("d", *(F.col(f"r_{n}").alias(n) for n in names))).alias("best")).select("pt_id", *(F.col(f"best.{n}") for n in names), F.col("best.d").alias("d"))
        best = cut(best)
        found = best if found is None else found.union(best)
        todo = cut(todo.join(best, "pt_id", "left_anti"))
        if r >= limit or r >= whole or not todo.take(1):
            return found
        radius *= 4


def line_crossings(crossings: DataFrame) -> DataFrame:
    """line_id, crossing (x and y as one key), t: where each line meets others, once for each point."""
    key = F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"))
    sides = [crossings.select(F.col(f"line_{s}").alias("line_id"), key.alias("crossing"), "x", "y", F.col(f"t_{s}").alias("t")) for s in "ab"]
    return sides[0].union(sides[1]).groupBy("line_id", "crossing").agg(F.min("t").alias("t"), F.min("x").alias("x"), F.min("y").alias("y"))


def graph(lines: DataFrame, unlinks: DataFrame | None = None, cell: float = CELL) -> dict[str, DataFrame]:
    """lines (with length), crossings (by pair of lines), line_crossings and points where lines meet."""
    crossings = without_unlinks(crossing_pairs(lines, cell=cell), unlinks)
    at = line_crossings(crossings)
    return {"lines": with_length(lines), "crossings": crossings, "line_crossings": at, "points": at.groupBy("crossing").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.count(F.lit(1)).alias("n_lines"))}


def graph_info(g: dict[str, DataFrame], points: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """One row: lines, crossings, points, point groups."""
    counts = [g["lines"].agg(F.count(F.lit(1)).alias("n_lines")), g["points"].agg(F.count(F.lit(1)).alias("n_crossings"))]
    counts += [(d.agg(F.count(F.lit(1)).alias(n)) if d is not None else g["lines"].sparkSession.range(1).select(F.lit(0).cast("long").alias(n))) for d, n in ((points, "n_points"), (groups, "n_groups"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def nearest_line(points: DataFrame, lines: DataFrame, first: float = 60.0) -> DataFrame:
    """pt_id, line_id, d, t: by distance, then line_id. Rings become four times as wide until every point has a line within its ring. Points and
    lines with a null coordinate are left out; without lines no point has any. Points at one place are searched for once."""
    columns, placed = lines.select("line_id", "x1", "y1", "x2", "y2"), points.select("pt_id", "x", "y").where("x is not null and y is not null")
    todo, found, radius = cut(grid.places(placed).select(F.struct("x", "y").alias("place"), "x", "y")), None, first
    ends = columns.agg(*(F.min(c) for c in ("x1", "x2", "y1", "y2")), *(F.max(c) for c in ("x1", "x2", "y1", "y2"))).first()
    box = todo.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None or box[0] is None:
        return todo.sparkSession.createDataFrame([], "pt_id long, line_id long, d double, t double")
    whole = max(max(ends[4], ends[5], box[1]) - min(ends[0], ends[1], box[0]), max(ends[6], ends[7], box[3]) - min(ends[2], ends[3], box[2])) * 1.5 + 1
    line = [F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")]
    while True:
        r = min(radius, whole)
        near = grid.points_near_lines(todo, columns, r)
        near = near.withColumn("d", G.point_segment_distance(F.col("x"), F.col("y"), *line)).withColumn("t", G.nearest_position(F.col("x"), F.col("y"), *line)).where(F.col("d") <= r)
        best = near.groupBy("place").agg(F.min(F.struct("d", F.col("r_line_id").alias("line_id"), "t")).alias("b"))
        best = cut(best)
        found = best if found is None else found.union(best)
        todo = cut(todo.join(best, "place", "left_anti"))
        if r >= whole or not todo.take(1):
            break
        radius *= 4
    of = placed.join(found.select(F.col("place.x").alias("x"), F.col("place.y").alias("y"), "b").hint("merge"), ["x", "y"])
    return of.groupBy("pt_id").agg(F.min("b").alias("b")).select("pt_id", "b.line_id", "b.d", "b.t")  # repeated ids: the nearest of their places


def lines_within(points: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """pt_id, line_id, d of all lines within radius."""
    d = G.point_segment_distance(F.col("x"), F.col("y"), *(F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    return grid.points_near_lines(points.select("pt_id", "x", "y"), lines.select("line_id", "x1", "y1", "x2", "y2"), radius).withColumn("d", d).where(F.col("d") <= radius).select("pt_id", F.col("r_line_id").alias("line_id"), "d")


def points_per_line(points: DataFrame, lines: DataFrame) -> DataFrame:
    near = nearest_line(points, lines)
    return near.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_points"))


def line_weights(attractions: DataFrame, lines: DataFrame) -> DataFrame:
    """line_id, weight: the sum over the attractions (pt_id, x, y, weight) nearest to it; 0 for others."""
    near = nearest_line(attractions, lines).join(attractions.select("pt_id", "weight"), "pt_id")
    sums = near.groupBy("line_id").agg(F.sum("weight").alias("weight"))
    return lines.select("line_id").join(sums, "line_id", "left").select("line_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def junctions(layer: DataFrame, other: DataFrame | None = None, unlinks: DataFrame | None = None, cell: float = CELL) -> DataFrame:
    """x, y. Two layers: where they cross. One layer: points that pairs of lines give at least twice; a pair that meets at least 2 % of a line's
    length away from its ends gives two."""
    pairs = without_unlinks(crossing_pairs(layer, other, cell), unlinks)
    if other is not None:
        return pairs.select("x", "y").distinct()
    inner = F.col("t_a").between(0.02, 0.98) | F.col("t_b").between(0.02, 0.98)
    return pairs.groupBy("x", "y").agg(F.sum(F.when(inner, 2).otherwise(1)).alias("n")).where("n >= 2").select("x", "y")
