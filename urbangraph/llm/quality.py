"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams between trusted documents and the corpus.

Words and word pairs are hashed into BUCKETS buckets. Two multinomials over the buckets, of trusted documents and of all
documents, give each bucket the weight log(p_trusted / p_corpus), in whole millionths so that sums don't depend on their
order. A document's score is the mean weight of its n-grams; it is kept if the base rules pass and the score reaches
THRESHOLD. DataFrame operations only; the only data sent around are the buckets' weights, a fixed number.

Trusted documents are at most `trusted_most` of the labelled ones of quality 1, those of least digest: a documented bound.
The corpus's counts cover every document.

Defined results: a null text counts as empty; documents without words fail the base rules and score 0; without trusted
documents all weights are 0; repeated rows count each and keep their rows; an empty table gives an empty table; further
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BUCKETS = 1 << 16
TRUSTED_MOST = 20_000
#: Mean weight of an n-gram in millionths, at least.
THRESHOLD = -120_000
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def windows(hashes: Column) -> Column:
    """All 3-word windows: hash and place, sorted, so that equal windows stand side by side."""
    n = F.size(hashes)
    at = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + 1), F.element_at(hashes, i + 2)).alias("w"), i.alias("i")))
    return F.sort_array(F.when(n < 3, F.array().cast("array<struct<w:bigint,i:int>>")).otherwise(at))


def repeat_words(ordered: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, from its sorted windows."""

    def place(x: Column, j: Column) -> Column:
        return F.when((F.get(ordered, j - 1)["w"] == x["w"]) | (F.get(ordered, j + 1)["w"] == x["w"]), x["i"])

    places = F.filter(F.transform(ordered, place), lambda i: i.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2))))).cast("long")


def pairs(hashes: Column) -> Column:
    n = F.size(hashes)
    return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + 1))))


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def hashed(df: DataFrame) -> DataFrame:
    """doc_id, text (no null), words, hashes of words."""
    docs = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return docs.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0)).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def weights(df: DataFrame, labels: DataFrame, trusted_most: int = TRUSTED_MOST) -> list[int]:
    """A weight for each bucket, in millionths."""
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("trusted")).where(F.col("trusted").isNotNull()).distinct().orderBy(F.xxhash64("trusted"), "trusted").limit(trusted_most)
    docs = hashed(df).join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted"), "left")  # at most trusted_most rows are sent
    grams = docs.select(F.explode(F.concat("hashes", pairs(F.col("hashes")))).alias("h"), F.col("trusted").isNotNull().cast("long").alias("t"))
    counts = grams.groupBy(bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    rows = {r["b"]: (r["n"], r["t"]) for r in counts.collect()}  # at most BUCKETS rows
    n, t = (sum(x[k] for x in rows.values()) for k in (0, 1))
    if not t:
        return [0] * BUCKETS
    return [round(1e6 * math.log((rows.get(b, (0, 0))[1] + 1) / (t + BUCKETS) / ((rows.get(b, (0, 0))[0] + 1) / (n + BUCKETS)))) for b in range(BUCKETS)]


def score(df: DataFrame, model: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """The counts of the base rules, score (mean weight in millionths), base_failed and kept, by document."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")

    def add(grams: Column) -> Column:
        return F.aggregate(grams, F.lit(0).cast("long"), lambda a, h: a + F.get(table, bucket(h)).cast("long"))

    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    docs = hashed(df).select(
        "doc_id",
        "hashes",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows(F.col("hashes")).alias("windows"),
    )
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    docs = docs.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("windows")).alias("n_repeat_words"),
        F.floor((add(F.col("hashes")) + add(pairs(F.col("hashes")))) / grams).cast("long").alias("score"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return docs.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality(df: DataFrame, labels: DataFrame, trusted_most: int = TRUSTED_MOST, threshold: int = THRESHOLD) -> DataFrame:
    return score(df, weights(df, labels, trusted_most), threshold)
