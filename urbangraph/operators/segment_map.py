"""From drawn polylines to a clean segment map, and points along region edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.lineage import cut
from urbangraph.operators import axial, grid, grouping, segments


#: Spark takes exploded tables for as small as the files they came from, so the joins here merge and broadcast nothing.
#: An unlink takes a point with cuts that is nearer than this.
UNLINK_MOST = 100.0


def split_polylines(polylines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """base_id, part (from 0), x1, y1, x2, y2 and the columns in keep: a row for each pair of neighbouring points."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("coords") - 1), lambda i: F.struct(F.element_at("coords", i)["x"].alias("x1"), F.element_at("coords", i)["y"].alias("y1"), F.element_at("coords", i + 1)["x"].alias("x2"), F.element_at("coords", i + 1)["y"].alias("y2")))
    rows = polylines.where(F.size("coords") >= 2).select("base_id", *keep, F.posexplode(pairs).alias("part", "s"))
    return rows.select("base_id", "part", "s.*", *keep)


def with_ids(parts: DataFrame) -> DataFrame:
    """line_id in the order of base_id and part."""
    keyed = parts.withColumn("key", F.struct("base_id", "part"))
    return grouping.numbered(keyed, "key", "line_id").drop("key")


def cuts(lines: DataFrame, extrude: float = 0.0, cell: float = axial.CELL) -> DataFrame:
    """line_a, line_b, x, y, t_a, t_b where lines meet inside; ends that touch are no cuts. Lines reach on by extrude at free ends."""
    if not extrude:
        found = axial.crossing_pairs(lines, cell=cell)
    else:
        length = F.nullif(G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.lit(0.0))
        ex, ey = (F.col("x2") - F.col("x1")) / length * extrude, (F.col("y2") - F.col("y1")) / length * extrude
        free = segments.ends(lines).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("x", "y"))).where("n = 1").groupBy("line_id").agg(F.max(F.when(F.col("end") == 0, 1)).alias("at1"), F.max(F.when(F.col("end") == 1, 1)).alias("at2"))
        longer = lines.join(free.hint("merge"), "line_id", "left").select("line_id", *(F.when(F.col(f"at{i}") == 1, F.coalesce(F.col(f"{c}{i}") + (e if i == 2 else -e), F.col(f"{c}{i}"))).otherwise(F.col(f"{c}{i}")).alias(f"{c}{i}") for i in (1, 2) for c, e in (("x", ex), ("y", ey))))
        found = axial.crossing_pairs(longer, cell=cell)
        ids = lines.select("line_id", "x1", "y1", "x2", "y2")
        for s in "ab":  # positions along the lines as drawn
            at = ids.withColumnRenamed("line_id", f"line_{s}")
            found = found.join(at.hint("merge"), f"line_{s}").withColumn(f"t_{s}", G.nearest_position(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).drop("x1", "y1", "x2", "y2")
    return found.where(~(F.col("t_a").isin(0.0, 1.0) & F.col("t_b").isin(0.0, 1.0)))


def cut_lines(lines: DataFrame, at: DataFrame) -> DataFrame:
    """line_id, base_id, part, x1, y1, x2, y2 of the pieces between the cuts of each line, by lead() along the line."""
    points = at.select(F.col("line_a").alias("line_id"), F.col("t_a").alias("t"), "x", "y").union(at.select("line_b", "t_b", "x", "y")).where("t > 0 and t < 1").dropDuplicates(["line_id", "t"])
    ends = lines.select("line_id", F.lit(0.0).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(lines.select("line_id", F.lit(1.0), "x2", "y2"))
    along = Window.partitionBy("line_id").orderBy("t")
    pieces = points.union(ends).select("line_id", "t", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(along).alias("x2"), F.lead("y").over(along).alias("y2"), (F.row_number().over(along) - 1).alias("piece"))
    return pieces.where("x2 is not null").join(lines.select("line_id", "base_id", "part").hint("merge"), "line_id").select("line_id", "base_id", "part", "piece", "x1", "y1", "x2", "y2")


def snap(lines: DataFrame, distance: float) -> DataFrame:
    """Points within distance of one another, and of such in turn, become the one of them with most segments (of these the least x, y)."""
    points = segments.ends(lines).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    points = cut(grouping.numbered(points.withColumn("key", F.struct("x", "y")), "key", "id").drop("key"))
    boxes = grid.boxed(points, "x", "y", "x", "y", distance), grid.boxed(points, "x", "y", "x", "y")
    near = grid.overlapping(*boxes, max(distance, 1e-6)).where((F.col("id") < F.col("r_id")) & (G.distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y")) <= distance)).select(F.col("id").alias("a"), F.col("r_id").alias("b"))
    labels = grouping.components(points.select(F.col("id").alias("node")), near)
    joined = points.join(labels.withColumnRenamed("node", "id").hint("merge"), "id")
    best = joined.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "x", "y")).alias("best"))
    moved = cut(joined.join(best.hint("merge"), "label").select("x", "y", F.col("best.x").alias("sx"), F.col("best.y").alias("sy")))
    for i in (1, 2):
        m = moved.select(F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), "sx", "sy")
        lines = lines.join(m.hint("merge"), [f"x{i}", f"y{i}"]).drop(f"x{i}", f"y{i}").withColumnRenamed("sx", f"x{i}").withColumnRenamed("sy", f"y{i}")
    return lines


def distinct_segments(lines: DataFrame) -> DataFrame:
    """Without segments without length and, of those with equal ends in either direction, all but the one of the least line_id."""
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    keyed = lines.where("x1 <> x2 or y1 <> y2").withColumn("p", F.least(a, b)).withColumn("q", F.greatest(a, b))
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy("p", "q").orderBy("line_id"))).where("n = 1").drop("p", "q", "n")


def trim_tails(lines: DataFrame, shortest: float) -> DataFrame:
    """Without chains from a dead end over points of two segments to a junction of three or more, as counted beforehand, that are shorter
    than that: each round adds the next segment to the chains still below it."""
    e = segments.ends(lines).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("x", "y")))
    far = e.select("line_id", F.col("end").alias("far"), F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("n").alias("to_n"))
    ways = cut(e.join(far.hint("merge"), "line_id").where("end <> far").join(segments.described(lines).select("line_id", "length").hint("merge"), "line_id").where((F.col("to_n") > 1) & (F.col("length") < shortest)))
    front = cut(ways.where("n = 1").select(F.col("line_id").alias("tail"), "line_id", "to_x", "to_y", "to_n", "length"))
    walked = front
    onward = ways.where("n = 2").select(F.col("line_id").alias("next"), "x", "y", F.col("to_x").alias("next_x"), F.col("to_y").alias("next_y"), F.col("to_n").alias("next_n"), F.col("length").alias("more"))
    while front.take(1):
        step = front.where("to_n = 2").join(onward.hint("merge"), (F.col("to_x") == F.col("x")) & (F.col("to_y") == F.col("y"))).where((F.col("next") != F.col("line_id")) & (F.col("length") + F.col("more") < shortest))
        front = cut(step.select("tail", F.col("next").alias("line_id"), F.col("next_x").alias("to_x"), F.col("next_y").alias("to_y"), F.col("next_n").alias("to_n"), (F.col("length") + F.col("more")).alias("length")))
        walked = walked.union(front)
    gone = walked.join(walked.where("to_n >= 3").select("tail"), "tail").select("line_id").distinct()
    return lines.join(gone.hint("merge"), "line_id", "left_anti")


def remove_detail(lines: DataFrame, deviation: float) -> DataFrame:
    """Chains of segments of one base, which alone meet in a point, with fewer points: in the order of line_id each segment still there keeps
    its start, and its end moves on over the next segment while the end lies within deviation (in the units of x and y) of the straight line from
    its start to the next segment's far end. The segment moved over goes. A segment doesn't move on to its own start.

    Which two segments meet alone is found by counts of points, and what can be joined lies within one base, so a task walks the chains of its
    bases one base at a time. Null base_ids are one base. An empty table stays empty."""
    e = segments.ends(lines).join(lines.select("line_id", "base_id").hint("merge"), "line_id")
    two = e.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("a"), F.max("line_id").alias("b"), F.count_distinct(F.coalesce("base_id", F.lit(-1))).alias("bases")).where("n = 2 and a < b and bases = 1")
    pairs = two.select("x", "y", F.explode(F.array(F.struct(F.col("a").alias("line_id"), F.col("b").alias("next")), F.struct(F.col("b").alias("line_id"), F.col("a").alias("next")))).alias("p")).select("x", "y", "p.*")
    met = lines.select("line_id", "base_id", "x1", "y1", "x2", "y2")
    for i in (1, 2):
        at = pairs.select("line_id", F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("next").alias(f"at{i}"))
        met = met.join(at.hint("merge"), ["line_id", f"x{i}", f"y{i}"], "left")
    alone = met.where("at1 is null and at2 is null").select("line_id", "base_id", "x1", "y1", "x2", "y2")
    itself = [F.coalesce(f"at{i}", "line_id").alias(f"at{i}") for i in (1, 2)]  # where there is no neighbour
    known = [F.coalesce("base_id", F.lit(0).cast("long")).alias("base"), F.col("base_id").isNull().alias("baseless")]
    chained = met.where("at1 is not null or at2 is not null").select("line_id", "x1", "y1", "x2", "y2", *itself, *known)

    def run(batches):
        now, rows = None, []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if now != (row.base, row.baseless):
                    out += contracted(rows, deviation)
                    now, rows = (row.base, row.baseless), []
                rows.append(row)
            yield frame(out)
        yield frame(contracted(rows, deviation))

    frame = lambda out: pd.DataFrame(out, columns=["line_id", "base", "baseless", "x1", "y1", "x2", "y2"])
    walked = chained.repartition("base", "baseless").sortWithinPartitions("base", "baseless", "line_id")
    kept = walked.mapInPandas(run, "line_id long, base long, baseless boolean, x1 double, y1 double, x2 double, y2 double")
    return alone.unionByName(kept.select("line_id", F.when(~F.col("baseless"), F.col("base")).alias("base_id"), "x1", "y1", "x2", "y2"))


def contracted(rows: list, deviation: float) -> list[tuple]:
    """The segments of one base (with the neighbour at each end, or their own line_id) after remove_detail."""
    line = {r.line_id: [(r.x1, r.y1), (r.x2, r.y2)] for r in rows}
    meet: dict[tuple[float, float], set[int]] = {}
    for r in rows:
        for point, other in (((r.x1, r.y1), r.at1), ((r.x2, r.y2), r.at2)):
            if other != r.line_id:
                meet.setdefault(point, set()).update((r.line_id, other))
    for one in sorted(line):
        if one not in line:
            continue
        start, end = line[one]
        while len(here := meet.get(end, ())) == 2:
            (other,) = here - {one}
            a, b = line[other]
            far = b if a == end else a
            dx, dy = far[0] - start[0], far[1] - start[1]
            off = (end[0] - start[0]) * dy - (end[1] - start[1]) * dx
            if far == start or off * off > deviation * deviation * (dx * dx + dy * dy):
                break
            del line[other]
            if far in meet:
                meet[far] = meet[far] - {other} | {one}
            end = line[one][1] = far
    return [(i, rows[0].base, rows[0].baseless, *a, *b) for i, (a, b) in line.items()]


def segment_map(polylines: DataFrame, road_centre_lines: bool = False, unlinks: DataFrame | None = None, snap_distance: float = 1.0, tail: float = 10.0, deviation: float = 1.0, extrude: float = 0.0) -> tuple[DataFrame, DataFrame | None]:
    """(segments: line_id, base_id, x1, y1, x2, y2; crossings that road centre lines don't connect at, or null)."""
    if road_centre_lines and unlinks is not None:
        raise ValueError("road centre lines take no unlinks")
    lines = cut(with_ids(split_polylines(polylines)))
    at = cuts(lines, extrude)
    out = None
    if road_centre_lines:
        out, pieces = at.select("x", "y").distinct(), lines.select("line_id", "base_id", "part", F.lit(0).alias("piece"), "x1", "y1", "x2", "y2")
    else:
        pieces = cut_lines(lines, axial.without_unlinked_points(at, unlinks, UNLINK_MOST))
    pieces = cut(grouping.numbered(pieces.withColumn("key", F.struct("line_id", "piece")).drop("line_id"), "key", "line_id").drop("key", "part", "piece"))
    clean = distinct_segments(snap(pieces, snap_distance) if snap_distance else pieces)
    clean = trim_tails(clean, tail) if tail else clean
    clean = remove_detail(clean.select("line_id", "base_id", "x1", "y1", "x2", "y2"), deviation) if deviation else clean
    return clean.select("line_id", "base_id", "x1", "y1", "x2", "y2"), out


def with_base_columns(result: DataFrame, layer: DataFrame, columns: list[str]) -> DataFrame:
    return result.join(layer.select("base_id", *columns), "base_id", "left")


def region_points(regions: DataFrame, interval: float) -> DataFrame:
    """region_id, k, x, y: the first corner, then a point every interval along the edge; on the last edge only where more than
    half an interval is left before the first corner again. Edges without length count for nothing; a null or empty ring has no points.
    Regions may have rings, outline and holes, in place of ring: points begin anew on each ring and are numbered through, ring by ring."""
    if "rings" in regions.columns:
        each = region_points(regions.select("region_id", F.posexplode("rings").alias("r", "ring")).select(F.struct("region_id", "r").alias("region_id"), "ring"), interval)
        return each.select("region_id.region_id", (F.row_number().over(Window.partitionBy("region_id.region_id").orderBy("region_id.r", "k")) - 1).cast("long").alias("k"), "x", "y")
    edges = regions.select("region_id", F.posexplode(G.ring_edges(F.col("ring"))).alias("i", "e")).select("region_id", "i", "e.*").withColumn("length", G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    ring = Window.partitionBy("region_id")
    edges = edges.withColumn("to", F.sum("length").over(ring.orderBy("i"))).withColumn("from", F.col("to") - F.col("length"))
    last = F.max_by(F.when(F.col("length") > 0, F.greatest("from", F.col("to") - 0.5 * interval)).otherwise(F.col("to")), "i").over(ring)
    edges = edges.withColumn("begin", F.greatest(F.ceil(F.col("from") / interval), F.lit(1))).withColumn("end", F.ceil(F.least("to", last) / interval) - 1)
    points = edges.where("length > 0 and begin <= end").withColumn("k", F.explode(F.sequence("begin", "end")))
    t = (F.col("k") * interval - F.col("from")) / F.col("length")
    points = points.select("region_id", F.col("k").cast("long").alias("k"), G.lerp(F.col("x1"), F.col("x2"), t).alias("x"), G.lerp(F.col("y1"), F.col("y2"), t).alias("y"))
    return edges.where("i = 0").select("region_id", F.lit(0).cast("long").alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(points)
