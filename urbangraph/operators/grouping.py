"""Groups of segments that go on nearly straight, their colours, and integration between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G
from urbangraph.functions import normalize as N
from urbangraph.lineage import cut
from urbangraph.operators import segments
from urbangraph.operators.frontier import first_visits, relax
from urbangraph.radii import Radius


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label (the least node of its component). links: a, b. Least labels of neighbours, then labels of labels."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = cut(step.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("changed")))
        labels = new.drop("changed")
        if not new.where("changed").take(1):
            return labels


def numbered(df: DataFrame, column: str, out: str) -> DataFrame:
    """Row numbers from 0 in the order of a column of distinct values: range partitions, and the rows of those before."""
    parts = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.join(F.broadcast(before), "__part").withColumn(out, F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1 + F.col("before")).drop("__part", "before")


def grouping(lines: DataFrame, threshold: float = 1.0, split_at_junctions: bool = False) -> DataFrame:
    """line_id, group_id (from 0, by least line_id). Where segments meet, pairs of ends are matched by least deviation, each end once, up
    to the threshold; with split_at_junctions only where two segments meet. Each round matches the pairs that are best for both ends."""
    ends = segments.ends(lines).join(segments.described(lines).select("line_id", "orientation"), "line_id")
    out = F.when(F.col("end") == 1, F.col("orientation")).otherwise(G.reversed_angle(F.col("orientation")))
    ends = ends.withColumn("out", out).withColumn("meeting", F.count(F.lit(1)).over(Window.partitionBy("x", "y"))).withColumn("id", F.col("line_id") * 2 + F.col("end"))
    a = ends.select("x", "y", "meeting", F.col("id").alias("a"), F.col("line_id").alias("la"), F.col("out").alias("oa"))
    b = ends.select("x", "y", F.col("id").alias("b"), F.col("line_id").alias("lb"), F.col("out").alias("ob"))
    deviation = 180.0 - G.angle_between(F.col("oa"), F.col("ob"))
    pairs = a.join(b, ["x", "y"]).where("a < b and la <> lb").withColumn("deviation", F.round(deviation, 9)).where(F.col("deviation") <= threshold)
    pairs = cut((pairs.where("meeting = 2") if split_at_junctions else pairs).select("a", "b", "la", "lb", "deviation"))
    matched = None
    while pairs.take(1):
        rank = F.struct("deviation", "a", "b")
        best = pairs.select(F.col("a").alias("e"), rank.alias("r")).union(pairs.select("b", rank)).groupBy("e").agg(F.min("r").alias("r"))
        now = best.groupBy("r").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("r.a", "r.b")
        now = cut(pairs.join(now, ["a", "b"]).select("a", "b", "la", "lb"))
        matched = now if matched is None else matched.union(now)
        used = now.select(F.col("a").alias("e")).union(now.select("b"))
        pairs = cut(pairs.join(used.withColumnRenamed("e", "a"), "a", "left_anti").join(used.withColumnRenamed("e", "b"), "b", "left_anti"))
    nodes = lines.select(F.col("line_id").alias("node"))
    links = matched.select(F.col("la").alias("a"), F.col("lb").alias("b")) if matched is not None else nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    labels = components(nodes, links)
    ids = numbered(labels.select("label").distinct(), "label", "group_id")
    return labels.join(ids, "label").select(F.col("node").alias("line_id"), F.col("group_id").cast("long").alias("group_id"))


def colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, colour: by descending valency, then node, each the lowest colour that no neighbour has. Each round colours the nodes
    whose neighbours of higher rank all have colours, which gives the same as one after the other. edges: a < b."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    valency = nodes.select("node").join(both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("v")), "node", "left").select("node", F.coalesce("v", F.lit(0)).alias("v"))
    rank = cut(valency.select("node", F.struct((-F.col("v")).alias("v"), "node").alias("rank")))
    higher = both.join(rank.withColumnRenamed("node", "a").withColumnRenamed("rank", "ra"), "a").join(rank.withColumnRenamed("node", "b").withColumnRenamed("rank", "rb"), "b")
    waits = cut(higher.where("rb < ra").select(F.col("a").alias("node"), F.col("b").alias("on")))
    done = cut(nodes.select("node").join(waits.select("node"), "node", "left_anti").withColumn("colour", F.lit(0)))
    while True:
        todo = waits.join(done.select("node"), "node", "left_anti")
        state = todo.join(done.select(F.col("node").alias("on"), "colour"), "on", "left").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count("colour").alias("ready"), F.collect_set("colour").alias("taken"))
        new = cut(state.where("n = ready").select("node", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken"))).alias("colour")))
        if not new.take(1):
            return done
        done = cut(done.union(new))


def group_colours(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """line_id, colour of its group; neighbouring groups differ."""
    edges = segments.groups(segments.adjacency(lines), groups).select(F.col("group_a").alias("a"), F.col("group_b").alias("b"))
    found = colours(groups.select(F.col("group_id").alias("node")).distinct(), edges)
    return groups.join(found.withColumnRenamed("node", "group_id"), "group_id").select("line_id", "colour")


def parts(ends: DataFrame) -> DataFrame:
    """line_id, part: the lines of a group that hang together, named by the least of them. ends: line_id, group_id, x, y."""
    met = ends.withColumn("first", F.min("line_id").over(Window.partitionBy("group_id", "x", "y")))
    found = components(ends.select(F.col("line_id").alias("node")).distinct(), met.where("first <> line_id").select(F.col("first").alias("a"), F.col("line_id").alias("b")))
    return found.select(F.col("node").alias("line_id"), F.col("label").alias("part"))


def group_depths(lines: DataFrame, groups: DataFrame, steps: float | None, connected: bool) -> DataFrame:
    """origin, group_id, d: the least changes of group from each group to each other. As a group costs nothing along itself, the search goes from
    group to group (from part to part, where a group's lines may lie apart), not along lines."""
    ends = segments.ends(lines).join(groups, "line_id")
    at = ends.withColumn("part", F.col("group_id")) if connected else ends.join(parts(ends), "line_id")
    here = at.select("x", "y", "part").distinct()
    edges = cut(here.withColumnRenamed("part", "src").join(here.withColumnRenamed("part", "dst"), ["x", "y"]).where("src <> dst").select("src", "dst").distinct())
    of = at.select(F.col("group_id").alias("origin"), F.col("part").alias("node")).distinct()
    found = first_visits(of, edges, steps)
    if connected:
        return found.withColumnRenamed("node", "group_id")
    return found.join(of.withColumnRenamed("origin", "group_id"), "node").groupBy("origin", "group_id").agg(F.min("d").alias("d"))


def group_integration(lines: DataFrame, groups: DataFrame, radius: Radius = Radius(), connected: bool = False) -> DataFrame:  # noqa: B008
    """group_id, node_count (groups reached, its own included), total_depth (changes of group), integration. connected: each group's lines
    are known to hang together at their ends, as those of `grouping` do; else they may lie apart."""
    found = group_depths(lines, groups, radius.steps, connected)
    if radius.walking is not None:
        d = segments.described(lines).join(groups, "line_id").select("line_id", "length", "group_id")
        ends = segments.ends(lines).join(d, "line_id").withColumn("id", F.col("line_id") * 2 + F.col("end"))
        along = d.select((F.col("line_id") * 2).alias("src"), (F.col("line_id") * 2 + 1).alias("dst"), F.col("length").alias("cost"))
        a, b = (ends.select("x", "y", F.col("id").alias(n)) for n in ("src", "dst"))
        sides = a.join(b, ["x", "y"]).where("src <> dst").select("src", "dst", F.lit(0.0).alias("cost"))
        edges = cut(along.union(along.select("dst", "src", "cost")).union(sides))
        seeds = ends.select(F.col("group_id").alias("origin"), F.col("id").alias("node"), F.lit(0.0).alias("d"))
        near = relax(seeds, edges, radius.walking).join(ends.select(F.col("id").alias("node"), "group_id"), "node").select("origin", "group_id").distinct()
        found = found.join(near, ["origin", "group_id"])
    sums = found.groupBy(F.col("origin").alias("group_id")).agg(F.count(F.lit(1)).alias("node_count"), F.sum("d").alias("total_depth"))
    return sums.withColumn("integration", N.network_integration(F.col("node_count"), F.col("total_depth")))
