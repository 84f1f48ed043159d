"""Paths with several distances at once: walking, steps, angular, axmeter and weights of lines, with limits on any of them together.

A node is a spot on a line (a crossing, or where a search starts) passed in one direction, so what an edge adds doesn't depend on the path before
it; axmeter adds each metre once more for each change of line so far, which a label carries. Edges go to the next spot along the line and, at
crossings, onto other lines: their number is that of spots and of pairs of lines at a crossing. A search keeps, for each origin and node, the
labels that no other is at least as good as in every distance that matters; with one distance that is the least.

Distances are kept as whole numbers in units of 1 / SCALE, so sums don't depend on their order; limits are inclusive. What isn't reached
within the limits is absent from a search, distance -1 in a distance table and score 0 in a score table. Empty tables give empty results; points
with a null coordinate are reached from nowhere and reach nothing. Repeated ids of attractions are attractions of their own at one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.lineage import cut
from urbangraph.operators import axial, grouping, segment_map, segments
from urbangraph.operators.frontier import first_visits, relax
from urbangraph.radii import Radius

SCALE = 1_000_000_000
DISTANCES = ("walking", "steps", "angular", "axmeter", "weights")


def units(x: Column) -> Column:
    return F.round(x * SCALE).cast("long")


def unit(kind: str, limit: float) -> int:
    return int(limit) if kind == "steps" else round(limit * SCALE)


def plain(kind: str, x: Column) -> Column:
    return x.cast("double") if kind == "steps" else x / SCALE


def needed(kind: str | None, radius: Radius) -> tuple[str, ...]:
    """The distances that a search by kind within radius has to carry."""
    wanted = {k for k in (kind, *radius.limits()) if k not in (None, "straight")}
    return tuple(d for d in DISTANCES if d in wanted or "axmeter" in wanted and d in ("walking", "steps"))


def line_steps(at: DataFrame) -> DataFrame:
    """src, dst, cost 1: lines that meet."""
    a, b = at.select(F.col("line_id").alias("src"), "crossing"), at.select(F.col("line_id").alias("dst"), "crossing")
    return cut(a.join(b, "crossing").where("src <> dst").select("src", "dst").distinct().withColumn("cost", F.lit(1.0)))


def by_steps_alone(kind: str | None, radius: Radius) -> bool:
    """Whether all that counts of a start is its line."""
    return kind == "steps" and set(radius.limits()) <= {"steps"}


class Network:
    """Spots and edges of an axial graph (see axial.graph) with starts (origin, line_id, t, d, ox, oy) on its lines; weight: a column of lines.
    Paths pass by starts only if through: targets between crossings are reached from the spot before them. Else edges go from crossing to crossing and
    the rounds of a search don't grow with the starts on a line."""

    def __init__(self, g: dict[str, DataFrame], starts: DataFrame, weight: str | None = None, through: bool = True):
        self.through = through
        self.lines = cut(segments.described(g["lines"]).select("line_id", "length", "orientation", (F.col(weight).cast("double") if weight else F.lit(0.0)).alias("weight")))
        none = F.lit(None)
        spots = g["line_crossings"].select("line_id", "t", "crossing", "x", "y", none.cast("long").alias("origin"), none.cast("double").alias("d"), none.cast("double").alias("ox"), none.cast("double").alias("oy"))
        begins = starts.select("line_id", "t", none.cast("string").alias("crossing"), none.cast("double").alias("x"), none.cast("double").alias("y"), "origin", "d", "ox", "oy")
        along = Window.partitionBy("line_id").orderBy("t", F.asc_nulls_last("crossing"), F.asc_nulls_last("origin"), "d")
        self.spots = cut(spots.unionByName(begins).withColumn("place", F.row_number().over(along)))

    def edges(self, metrics: tuple[str, ...]) -> DataFrame:
        """src, dst, walking, steps, angular, weights, x, y (of the crossing passed at dst, or null); alike edges once."""
        on = self.spots.join(self.lines, "line_id")
        zero = F.lit(0).cast("long")
        costs = [units(F.col("part") * F.col("length")).alias("walking"), zero.alias("steps"), zero.alias("angular"), units(F.col("part") * F.col("weight")).alias("weights")]
        spot = F.struct("place", "t", "x", "y")
        stop = spot if self.through else F.when(F.col("crossing").isNotNull(), spot)
        before = Window.partitionBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
        nexts = on.withColumns({"ahead": F.last(stop, True).over(before.orderBy(F.desc("place"))), "back": F.last(stop, True).over(before.orderBy("place"))})
        ahead, back = (
            nexts.where(f"{side} is not null").withColumn("part", F.abs(F.col(f"{side}.t") - F.col("t"))).select(node("line_id", "place", way).alias("src"), node("line_id", F.col(f"{side}.place"), way).alias("dst"), *costs, f"{side}.x", f"{side}.y")
            for side, way in (("ahead", 1), ("back", 0))
        )
        ways = on.where("crossing is not null").withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
        ways = ways.withColumn("heading", F.when(F.col("way") == 1, F.col("orientation")).otherwise(G.reversed_angle(F.col("orientation"))))
        a, b = (ways.select("crossing", "x", "y", F.col("line_id").alias(f"line_{s}"), node("line_id", "place", F.col("way")).alias(n), F.col("heading").alias(f"h_{s}")) for s, n in (("a", "src"), ("b", "dst")))
        turn = units(G.angle_between(F.col("h_a"), F.col("h_b"))) if "angular" in metrics else zero
        turns = a.join(b.drop("x", "y"), "crossing").where("line_a <> line_b").select("src", "dst", zero.alias("walking"), F.lit(1).cast("long").alias("steps"), turn.alias("angular"), zero.alias("weights"), "x", "y")
        return cut(ahead.unionByName(back).unionByName(turns))

    def seeds(self, metrics: tuple[str, ...], weight_per_metre: float = 0.0) -> DataFrame:
        """origin, node, ox, oy and metrics at each start, in both directions; where it lies at a crossing also on the lines that cross there, one step
        away, to which a path without a direction yet doesn't turn."""
        far, zero, one = units(F.col("d")), F.lit(0).cast("long"), F.lit(1).cast("long")
        begins = self.spots.where("origin is not null").select("line_id", "t", "place", "origin", "d", "ox", "oy")
        at = self.spots.where("crossing is not null").select("line_id", "t", "crossing", "place")
        there = begins.drop("place").join(at.drop("place"), ["line_id", "t"]).withColumnRenamed("line_id", "own")
        beside = there.drop("t").join(at.drop("t"), "crossing").where("line_id <> own").select("line_id", "place", "origin", "d", "ox", "oy", one.alias("steps"))
        ways = begins.select("line_id", "place", "origin", "d", "ox", "oy", zero.alias("steps")).unionByName(beside).withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
        first = {"walking": far, "axmeter": far, "steps": F.col("steps"), "weights": units(weight_per_metre * F.col("d"))}
        return ways.select("origin", node("line_id", "place", F.col("way")).alias("node"), "ox", "oy", *(first.get(m, zero).alias(m) for m in metrics))

    def ends(self, targets: DataFrame) -> DataFrame:
        """Targets (target, line_id, t, d) with the nodes they are reached from: the last spot before in either direction; leg and part are the way
        from there along the line, in units and as a share of its length."""
        other = self.spots.select("line_id", "t", "place", F.lit(0).alias("kind"), F.lit(None).cast(targets.schema["target"].dataType).alias("target"), F.lit(None).cast("double").alias("d"))
        both = other.unionByName(targets.select("line_id", "t", F.lit(None).cast("int").alias("place"), F.lit(1).alias("kind"), "target", "d"))
        up = Window.partitionBy("line_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("line_id").orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
        at = F.when(F.col("kind") == 0, F.struct("place", F.col("t").alias("from")))
        found = both.withColumns({"before": F.last(at, True).over(up), "after": F.last(at, True).over(down)}).where("kind = 1")
        sides = F.array(F.struct(F.col("before").alias("spot"), F.lit(1).alias("way")), F.struct(F.col("after").alias("spot"), F.lit(0).alias("way")))
        each = found.withColumn("side", F.explode(sides)).where("side.spot is not null").join(self.lines, "line_id")
        part = F.abs(F.col("t") - F.col("side.spot.from"))
        return each.select("target", node("line_id", F.col("side.spot.place"), F.col("side.way")).alias("node"), "d", part.alias("part"), (part * F.col("length")).alias("leg"), (part * F.col("weight")).alias("heft"))


    def middles(self) -> DataFrame:
        """As ends, the middle of each line from all its spots: the last way isn't counted as axmeter, so what enters the line farther off may be nearer."""
        ways = self.spots.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).where("(way = 1 and t <= 0.5) or (way = 0 and t >= 0.5)").join(self.lines, "line_id")
        part = F.abs(F.col("t") - 0.5)
        return ways.select(F.col("line_id").alias("target"), node("line_id", "place", F.col("way")).alias("node"), F.lit(0.0).alias("d"), part.alias("part"), (part * F.col("length")).alias("leg"), (part * F.col("weight")).alias("heft"))


def node(line: str, place: str | Column, way: int | Column) -> Column:
    place = F.col(place) if isinstance(place, str) else place
    way = F.lit(way) if isinstance(way, int) else way
    return F.struct(F.col(line).alias("line"), place.cast("int").alias("place"), way.cast("int").alias("way"))


def undominated(labels: Column, metrics: tuple[str, ...]) -> Column:
    """Of labels (metrics, fresh) those that no other is at least as good as in all metrics; of equal ones the older."""

    def beats(b: Column, a: Column) -> Column:
        as_good = reduce(lambda x, y: x & y, (b[m] <= a[m] for m in metrics))
        return as_good & (reduce(lambda x, y: x | y, (b[m] < a[m] for m in metrics)) | (b["fresh"] < a["fresh"]))

    return F.filter(labels, lambda a: ~F.exists(labels, lambda b: beats(b, a)))


def search(seeds: DataFrame, edges: DataFrame, metrics: tuple[str, ...], radius: Radius = Radius()) -> DataFrame:  # noqa: B008
    """origin, node and metrics of all labels within the limits that none beats. seeds: origin, node, metrics, and with a straight limit ox, oy; edges: src, dst,
    the distances they add, and with a straight limit x, y, which must lie within it of the origin. In rounds: labels that are new go
    one edge further, and meet the labels known at the same node."""
    limits = {k: unit(k, v) for k, v in radius.limits().items() if k != "straight"}
    within = reduce(lambda x, y: x & y, (F.col(k) <= v for k, v in limits.items()), F.lit(True))
    straight = radius.straight
    if len(metrics) == 1 and straight is None:
        (m,) = metrics
        found = relax(seeds.select("origin", "node", F.col(m).alias("d")), edges.select("src", "dst", F.col(m).alias("cost")), limits.get(m))
        return found.select("origin", "node", F.col("d").alias(m))
    place = ["origin", "node", *(("ox", "oy") if straight is not None else ())]
    label = F.struct(*metrics, "fresh")

    def kept(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("origin", "node").agg(F.collect_set(label).alias("labels"), *(F.first(c).alias(c) for c in place[2:]))
        return cut(best.withColumn("l", F.explode(undominated(F.col("labels"), metrics))).select(*place, "l.*"))

    known = kept(seeds.withColumn("fresh", F.lit(1)).where(within).select(*place, *metrics, "fresh"))
    adds = {m: F.col(f"_{m}") for m in metrics if m != "axmeter"}
    if "axmeter" in metrics:
        adds["axmeter"] = F.col("_walking") * (F.col("steps") + 1)
    onward = edges.select("src", "dst", *(F.col(m).alias(f"_{m}") for m in adds if m != "axmeter"), *(F.col(c).alias(f"_{c}") for c in ("x", "y") if straight is not None))
    while True:
        front = known.where("fresh = 1")
        if not front.take(1):
            return known.select("origin", "node", *metrics)
        step = front.join(onward, front["node"] == onward["src"])
        if straight is not None:
            step = step.where(F.col("_x").isNull() | (G.distance(F.col("ox"), F.col("oy"), F.col("_x"), F.col("_y")) <= straight))
        step = step.select("origin", F.col("dst").alias("node"), *place[2:], *((F.col(m) + adds[m]).alias(m) for m in metrics), F.lit(1).alias("fresh")).where(within)
        known = kept(known.withColumn("fresh", F.lit(0)).unionByName(step))


def from_lines(g: dict[str, DataFrame]) -> DataFrame:
    """Starts in the middle of each line."""
    return g["lines"].select(F.col("line_id").alias("origin"), "line_id", F.lit(0.5).alias("t"), F.lit(0.0).alias("d"), ((F.col("x1") + F.col("x2")) / 2).alias("ox"), ((F.col("y1") + F.col("y2")) / 2).alias("oy"))


def from_points(g: dict[str, DataFrame], points: DataFrame) -> DataFrame:
    """Starts on the line nearest to each point (pt_id, x, y)."""
    near = axial.nearest_line(points, g["lines"])
    return near.join(points.select("pt_id", F.col("x").alias("ox"), F.col("y").alias("oy")).dropDuplicates(["pt_id"]), "pt_id").select(F.col("pt_id").alias("origin"), "line_id", "t", "d", "ox", "oy")


def reached(g: dict[str, DataFrame], starts: DataFrame, kind: str | None, radius: Radius, targets: DataFrame | str | None = None, weight: str | None = None, weight_per_metre: float = 0.0) -> DataFrame:
    """origin, target, d: the least distance by kind from each start to each target that a path within all limits reaches; without a kind
    d is 0. Targets: the lines' middles (null), "junctions" (x, y as a struct), or points (pt_id, x, y), to which the way from their nearest line
    counts. A metre off a line weighs weight_per_metre. The way from a start to its line counts as walking and axmeter; the last way to a line's middle doesn't count as axmeter."""
    radius.only("a search of the network", "walking", "steps", "angular", "axmeter", "straight")
    if kind not in (None, *DISTANCES):
        raise ValueError(f"no paths by {kind}")
    metrics, to_points = needed(kind, radius) or ("steps",), isinstance(targets, DataFrame)
    if targets is None and by_steps_alone(kind, radius):
        seeds = starts.select("origin", F.col("line_id").alias("node"))
        return first_visits(seeds, line_steps(cut(g["line_crossings"])), radius.steps).withColumnRenamed("node", "target")
    network = Network(g, starts, weight, through=to_points)
    labels = cut(search(network.seeds(metrics, weight_per_metre), network.edges(metrics), metrics, radius))
    if isinstance(targets, str):
        spots = network.spots.where("crossing is not null").withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
        ends = spots.select(F.struct("x", "y").alias("target"), node("line_id", "place", F.col("way")).alias("node"), *(F.lit(0.0).alias(c) for c in ("d", "part", "leg", "heft")))
    elif to_points:
        ends = network.ends(axial.nearest_line(targets, g["lines"]).withColumnRenamed("pt_id", "target"))
    else:
        ends = network.middles()
    ends = ends.withColumnRenamed("d", "off")
    on = labels.join(ends, "node")
    whole = {"walking": units(F.col("leg") + F.col("off")), "weights": units(F.col("heft") + weight_per_metre * F.col("off"))}
    if to_points:
        whole["axmeter"] = units(F.col("leg") + F.col("off")) * (F.col("steps") + 1)
    on = on.select("origin", "target", *((F.col(m) + whole[m] if m in whole else F.col(m)).alias(m) for m in metrics))
    for k, v in radius.limits().items():
        if k != "straight":
            on = on.where(F.col(k) <= unit(k, v))
    if radius.straight is not None and to_points:
        at = targets.select(F.col("pt_id").alias("target"), "x", "y").dropDuplicates(["target"])
        begin = starts.select("origin", "ox", "oy").dropDuplicates(["origin"])
        on = on.join(at, "target").join(begin, "origin").where(G.distance(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) <= radius.straight)
    least = plain(kind, F.min(kind)) if kind else F.lit(0.0)
    return on.groupBy("origin", "target").agg(least.alias("d"))


def alike(kind: str | None, radius: Radius) -> list[str]:
    """What starts have to share so that a search reaches the same from them."""
    return ["line_id"] if by_steps_alone(kind, radius) else ["line_id", "t", "d", *(("ox", "oy") if radius.straight is not None else ())]


def one_for_each_place(starts: DataFrame, kind: str | None, radius: Radius) -> DataFrame:
    """Of starts that a search reaches the same from the one of the least origin."""
    keys = alike(kind, radius)
    rest = [c for c in ("t", "d", "ox", "oy") if c not in keys]
    return starts.groupBy(*keys).agg(F.min("origin").alias("origin"), *(F.min(c).alias(c) for c in rest)).select("origin", "line_id", "t", "d", "ox", "oy")


def all_targets(g: dict[str, DataFrame], targets: DataFrame | str | None) -> DataFrame:
    if isinstance(targets, str):
        return g["points"].select(F.struct("x", "y").alias("target"))
    return g["lines"].select(F.col("line_id").alias("target")) if targets is None else targets.select(F.col("pt_id").alias("target"))


def attraction_distance(g: dict[str, DataFrame], attractions: DataFrame, kind: str, radius: Radius = Radius(), targets: DataFrame | str | None = None, weight: str | None = None, weight_per_metre: float = 0.0) -> DataFrame:  # noqa: B008
    """target, distance to the nearest attraction (pt_id, x, y), -1 where none is within the limits. All attractions are one origin, unless a
    straight limit needs to know which one a path comes from."""
    starts = from_points(g, attractions)
    if radius.straight is None:
        starts = one_for_each_place(starts, kind, radius).withColumn("origin", F.lit(0).cast("long"))
    found = reached(g, starts, kind, radius, targets, weight, weight_per_metre).groupBy("target").agg(F.min("d").alias("d"))
    return all_targets(g, targets).join(found, "target", "left").select("target", F.coalesce("d", F.lit(-1.0)).alias("distance"))


def attraction_reach(g: dict[str, DataFrame], attractions: DataFrame, kind: str, radius: Radius = Radius(), decay: str = "constant", constant: float = 1.0, targets: DataFrame | str | None = None, weight: str | None = None) -> DataFrame:  # noqa: B008
    """target, score: over the attractions (pt_id, x, y, value > 0) that a path within the limits reaches, the sum of value times decay. Rows of
    attractions with a column owner are parts of it: of an owner's parts the best one counts (see polygon_attractions)."""
    valued = attractions.where(F.col("value") > 0)
    starts = cut(from_points(g, valued.dropDuplicates(["pt_id"])))
    keys, firsts = alike(kind, radius), cut(one_for_each_place(starts, kind, radius))
    found = reached(g, firsts, kind, radius, targets, weight)
    limit = radius.limits().get(kind)
    scale = None if limit is None else limit + (kind == "steps")
    held = starts.select(F.col("origin").alias("pt_id"), *keys).join(firsts.select("origin", *keys).hint("merge"), keys).join(valued.hint("merge"), "pt_id")
    held = held.groupBy("origin", "owner").agg(F.max("value").alias("value")) if "owner" in valued.columns else held.groupBy("origin").agg(F.sum("value").alias("value"))
    scored = found.join(held.hint("merge"), "origin").withColumn("s", F.col("value") * G.decay(F.col("d"), decay, constant, scale))
    if "owner" in valued.columns:
        scored = scored.groupBy("target", "owner").agg(F.max("s").alias("s"))
    sums = scored.groupBy("target").agg(F.sum("s").alias("score"))
    return all_targets(g, targets).join(sums, "target", "left").select("target", F.coalesce("score", F.lit(0.0)).alias("score"))


def polygon_attractions(regions: DataFrame, interval: float, distribution: str = "copy") -> DataFrame:
    """Regions (region_id, ring, value) as attractions at points an interval apart along their edge. copy: each point has the region's value and the
    best of them counts; divide: each has an equal share of it and they add up."""
    if distribution not in ("copy", "divide"):
        raise ValueError(f"no distribution by {distribution}")
    points = segment_map.region_points(regions, interval).join(regions.select("region_id", "value").dropDuplicates(["region_id"]), "region_id")
    points = points.select("region_id", "x", "y", "value", F.count(F.lit(1)).over(Window.partitionBy("region_id")).alias("n"), F.struct("region_id", "k").alias("key"))
    named = grouping.numbered(points, "key", "pt_id")
    if distribution == "divide":
        return named.select("pt_id", "x", "y", (F.col("value") / F.col("n")).alias("value"))
    return named.select("pt_id", "x", "y", "value", F.col("region_id").alias("owner"))


COLLECTED = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def by_group(values: DataFrame, members: DataFrame, column: str, how: str) -> DataFrame:
    """group_id and the column over the points (target) of each group (members: pt_id, group_id): avg, sum, min or max, negative values not counted;
    -1 for a group without others."""
    joined = members.join(values.withColumnRenamed("target", "pt_id"), "pt_id", "left")
    counted = F.when(F.col(column) >= 0, F.col(column))
    return joined.groupBy("group_id").agg(F.coalesce(COLLECTED[how](counted), F.lit(-1.0)).alias(column))
