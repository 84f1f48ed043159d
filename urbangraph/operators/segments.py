"""The segment graph: segments joined where end points are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.functions import geometry as G


def described(lines: DataFrame) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return lines.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("orientation", G.orientation(dx, dy))


def ends(lines: DataFrame) -> DataFrame:
    """line_id, end (0 start, 1 end), x, y."""
    return lines.select("line_id", F.lit(0).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(lines.select("line_id", F.lit(1), "x2", "y2"))


def dead_ends(lines: DataFrame) -> DataFrame:
    return ends(lines).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line_id")).where("n = 1").select("line_id", "x", "y")


def adjacency(lines: DataFrame) -> DataFrame:
    """src, src_end, dst, forward (dst is entered at its start), turn in degrees, walk (half of both lengths), x, y."""
    d = described(lines).select("line_id", "length", "orientation")
    e = ends(lines).join(d, "line_id")
    a = e.select(F.col("line_id").alias("src"), F.col("end").alias("src_end"), "x", "y", F.col("length").alias("src_length"), F.when(F.col("end") == 1, F.col("orientation")).otherwise(G.reversed_angle(F.col("orientation"))).alias("out"))
    b = e.select(F.col("line_id").alias("dst"), (F.col("end") == 0).alias("forward"), "x", "y", F.col("length").alias("dst_length"), F.when(F.col("end") == 0, F.col("orientation")).otherwise(G.reversed_angle(F.col("orientation"))).alias("into"))
    pairs = a.join(b, ["x", "y"]).where("src <> dst")
    return pairs.select("src", "src_end", "dst", "forward", G.angle_between(F.col("out"), F.col("into")).alias("turn"), ((F.col("src_length") + F.col("dst_length")) / 2).alias("walk"), "x", "y")


def states(lines: DataFrame) -> DataFrame:
    """Edges between (line, direction) states, as src, dst (twice the line_id, one more if forward), turn, walk."""
    edges = adjacency(lines)
    return edges.select((F.col("src") * 2 + F.col("src_end")).alias("src"), (F.col("dst") * 2 + F.col("forward").cast("int")).alias("dst"), "turn", "walk")


def groups(adjacency: DataFrame, of: DataFrame) -> DataFrame:
    """Connected pairs of groups: group_a < group_b, from of (line_id, group_id)."""
    a = of.select(F.col("line_id").alias("src"), F.col("group_id").alias("group_a"))
    b = of.select(F.col("line_id").alias("dst"), F.col("group_id").alias("group_b"))
    return adjacency.join(a, "src").join(b, "dst").where("group_a < group_b").select("group_a", "group_b").distinct()
