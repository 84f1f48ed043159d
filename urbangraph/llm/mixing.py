"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target of words; a document's expected copies are target / words of its source. Documents of a source
stand in a fixed order; expected copies are added up along it from one offset (from a digest of seed and source), and a
document is emitted once for each integer that its own stretch of the sum crosses. All documents of a source expect
equally many copies, so the sum before the k-th document is k - 1 times that, and a document's number k is all it needs.

Numbers come without a whole source in one task: documents fall into at most `buckets` buckets dealt out to the sources by
their numbers of documents, by a digest of the identifier; counts by bucket are added up along the buckets (at most
buckets + sources rows), and only within a bucket documents are sorted, by size, so that any stretch has documents of all sizes.

Defined results: a null text has no words; rows without a source are a source of their own, last in order; repeated rows
count as often as they stand there (tied rows are interchangeable); documents without words may be copied, to no effect
on words; an empty table gives an empty table; columns whose names clash with those made here are not read or kept by `targets`,
and `mixed` returns the input's own columns.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.llm.arrays import keyed, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the input, and most words of a source for each of its own.
SHARE, MOST = 1.5, 2.0
BUCKETS = 4096
#: Documents of a bucket, at least: enough of all sizes.
LEAST_ROWS = 500
#: Rows (a source or bucket each) that are sent to all executors; more are joined by a shuffle.
MOST_SENT = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(*parts: Column) -> Column:
    """Evenly spread in [0, 1), from the first 8 hexadecimal digits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: source, docs, all_docs, source_size, target double, copies double (expected copies of its documents).

    The targets are min(MOST * size, level * weight); level makes them add up to SHARE of all words. Sources in order of MOST *
    size / weight reach their limit one after the other, so level follows from sums along that order."""
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(MOST))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    whole = Window.partitionBy(F.lit(1))
    below, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level)
    by = by.withColumn("found", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(whole).getField("level"))
    target = F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap")))
    return by.select("source", "docs", F.sum("docs").over(whole).alias("all_docs"), "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("copies"))


def numbered(sizes: DataFrame, by_source: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """sizes (doc_id, source, size) with its source's row and `k`, its number from 1 in its source."""
    rows = F.greatest(F.lit(LEAST_ROWS), F.col("all_docs") / F.lit(buckets))
    dealt = by_source.withColumn("parts", F.ceil(F.col("docs") / rows).cast("long")).withColumnRenamed("source", "of").drop("all_docs")
    if by_source.count() <= MOST_SENT:
        dealt = F.broadcast(dealt)
    docs = sizes.join(dealt, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    docs = docs.withColumn("bucket", F.floor(fraction(F.col("doc_id")) * F.col("parts")))
    counts = docs.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("source").alias("of"), F.col("bucket").alias("in"), before.alias("before"))
    docs = docs.withColumn("row", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie")))
    if counts.count() <= MOST_SENT:
        counts = F.broadcast(counts)
    return docs.join(counts, docs["source"].eqNullSafe(counts["of"]) & (docs["bucket"] == counts["in"])).withColumn("k", F.col("before") + F.col("row"))


def crossed(seed: int) -> Column:
    """Integers crossed by the k-th document's stretch."""
    offset = fraction(F.lit(seed), F.col("source"))
    return (F.floor(F.col("k") * F.col("copies") + offset) - F.floor((F.col("k") - 1) * F.col("copies") + offset)).cast("long")


def mix(df: DataFrame, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of its copies), copies_taken."""
    docs = taken(df, seed, buckets)
    return docs.select("doc_id", "size", "source_size", "target", (F.col("copies_taken") * F.col("size")).alias("taken"), "copies_taken")


def taken(df: DataFrame, seed: int, buckets: int) -> DataFrame:
    sizes = saved(df.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")  # texts are counted once
    return numbered(sizes, targets(sizes), buckets).withColumn("copies_taken", crossed(seed))


def mixed(df: DataFrame, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """The rows of df, each as often as it is taken. Numbers are found on narrow rows; texts are dealt once, by identifier where
    identifiers are unique, else by identifier, source and digest, with a number for repeated rows."""
    rows = saved(taken(df, seed, buckets).select("doc_id", "source", "tie", "copies_taken"), "taken")
    c = rows.where("copies_taken > 0").alias("c")
    if keyed(rows, "doc_id"):
        docs, same = df.alias("d"), F.col("d.doc_id") == F.col("c.doc_id")
        whole = [F.col(f"d.`{n}`").alias(n) for n in df.columns]
    else:
        whole = [F.col(f"d.row.`{n}`").alias(n) for n in df.columns]
        docs = df.select(F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("row"), "doc_id", "source", F.xxhash64("text").alias("tie"))
        again = F.row_number().over(Window.partitionBy("doc_id", "source", "tie").orderBy(F.lit(1)))  # repeated rows only
        docs, c = docs.withColumn("again", again).alias("d"), rows.withColumn("again", again).where("copies_taken > 0").alias("c")
        same = reduce(and_, (F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("doc_id", "source", "tie", "again")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("c.copies_taken"))).alias("copy")
    return docs.join(c, same).select(F.struct(*whole).alias("row"), copies).select(*(F.col(f"row.`{n}`") for n in df.columns))
