"""Bounded shortest paths from many origins as joins: each round extends the states that got better by one edge, keeps the least
cost of each, and drops what lies beyond the limit or isn't better than what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.lineage import cut


def first_visits(seeds: DataFrame, edges: DataFrame, limit: float | None = None) -> DataFrame:
    """origin, node, d as by relax, where every edge costs 1, goes both ways and seeds have d 0: what a round reaches is final, and its neighbours lie in
    it, in the round before or in the next one, so only two rounds are held against what is found; those before are read once, at the end."""
    front = cut(seeds.select("origin", "node").distinct())
    last, rounds, d = front.limit(0), [front.withColumn("d", F.lit(0.0))], 0
    while limit is None or d < int(limit):
        step = front.join(edges.select("src", "dst"), front["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).distinct()
        new = cut(step.join(front.union(last), ["origin", "node"], "left_anti"))
        if not new.take(1):
            break
        last, front, d = front, new, d + 1
        rounds.append(new.withColumn("d", F.lit(float(d))))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    return out


def relax(seeds: DataFrame, edges: DataFrame, limit: float | None = None, rounds: int | None = None) -> DataFrame:
    """origin, node, d. seeds: origin, node, d; edges: src, dst, cost. A cost of all origins together (multi-source) comes from one origin
    value for all."""
    best = lambda df: df.groupBy("origin", "node").agg(F.min("d").alias("d"))
    known = cut(best(seeds if limit is None else seeds.where(F.col("d") <= limit)))
    front, done = known, 0
    while rounds is None or done < rounds:
        step = front.join(edges, front["node"] == edges["src"]).select("origin", F.col("dst").alias("node"), (F.col("d") + F.col("cost")).alias("d"))
        step = best(step if limit is None else step.where(F.col("d") <= limit))
        old = known.withColumnRenamed("d", "old")
        front = cut(step.join(old, ["origin", "node"], "left").where(F.col("old").isNull() | (F.col("d") < F.col("old"))).select("origin", "node", "d"))
        if not front.take(1):
            break
        known = cut(best(known.union(front)))
        done += 1
    return known
