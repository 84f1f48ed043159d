"""Operator 13: resampling documents towards a target distribution by hashed features.

Features of a text are its words and its pairs of neighbouring words. Each task keeps a trie of the words it meets: below the root the
words, below each the words that came after it. A node holds how often its run was met, and the CRC state that its run ends in, from which
a child's follows by the child's bytes alone. Counts are handed over as bucket totals, which Spark adds up; in a second pass documents walk
the same paths with the buckets' gains attached. A trie that has outgrown NODES hands over its counts and starts anew, so memory is bounded
and no feature is lost.

Null and empty texts have no features: weight 0. Null doc_ids are drawn last among equal scores, and their noise is that of the text "null".
Repeated rows each take part; rows that agree in everything are numbered in any order. Other columns are not read. Without documents the
result is empty; without target texts all gains come from the formula with t = T = 0."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.llm.arrays import as_arrow, pieces, saved

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Nodes of a trie before it starts anew: some 5 MB.
NODES = 40_000
#: Bytes of a text whose words are listed at once.
RUN = 1 << 14
#: Bytes of words stay, A-Z in lower case; all others become spaces. Bytes from 128 on are those of letters beyond ASCII.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about RUN bytes."""
    data, at = data.translate(FOLD), 0
    while at < len(data):
        to = data.find(b" ", at + RUN)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


class Node:
    """A word: its CRC state, its value (count or gain) and the values of the words after it."""

    __slots__ = ("state", "value", "after")

    def __init__(self, state: int, value: int):
        self.state, self.value, self.after = state, value, {}


class Trie:
    """Paths of one or two words. With gains its values are gains; without, counts."""

    def __init__(self, gains: list[int] | None = None):
        self.gains, self.top, self.met = gains, {}, 0
        self.totals = [0] * BUCKETS

    def outgrown(self, words: int) -> bool:
        """Whether it has more than NODES nodes, having met so many words since it was asked last."""
        self.met += words
        if self.met > NODES:
            self.met = len(self.top) + sum(len(n.after) for n in self.top.values())
        return self.met > NODES

    def count(self, text: bytes) -> None:
        before = None
        for words in runs(text):
            top = self.top
            for w in words:
                node = top.get(w)
                if node is None:
                    node = top[w] = Node(crc32(w), 0)
                node.value += 1
                if before is not None:
                    after = before.after
                    after[w] = after.get(w, 0) + 1
                before = node
            if self.outgrown(len(words)):
                self.hand_over()
                before = None if before is None else self.top.setdefault(words[-1], Node(before.state, 0))

    def hand_over(self) -> None:
        """Adds the counts to their buckets' totals and forgets all nodes."""
        totals = self.totals
        for node in self.top.values():
            totals[node.state % BUCKETS] += node.value
            for w, n in node.after.items():
                totals[crc32(b" " + w, node.state) % BUCKETS] += n
        self.top, self.met = {}, 0

    def walk(self, text: bytes) -> tuple[int, int]:
        """(number of words, sum of the gains of all features)."""
        gains, before, total, n = self.gains, None, 0, 0
        for words in runs(text):
            top = self.top
            for w in words:
                node = top.get(w)
                if node is None:
                    state = crc32(w)
                    node = top[w] = Node(state, gains[state % BUCKETS])
                total += node.value
                if before is not None:
                    gain = before.after.get(w)
                    if gain is None:
                        gain = before.after[w] = gains[crc32(b" " + w, before.state) % BUCKETS]
                    total += gain
                before = node
            n += len(words)
            if self.outgrown(len(words)):
                self.top, self.met = {}, 0
        return n, total


def encoded(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.large_binary()):
        yield text.as_py() or b""


def bucket_totals(texts: DataFrame) -> DataFrame:
    """bucket, n: how many features of all texts (column text) fall into each bucket that any falls into."""

    def run(batches):
        trie = Trie()
        for batch in pieces(batches):
            for text in encoded(batch):
                trie.count(text)
        trie.hand_over()
        found = [b for b, n in enumerate(trie.totals) if n]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([trie.totals[b] for b in found], pa.int64())], ["bucket", "n"])

    return as_arrow(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """Of each bucket, from the totals of the corpus and of the target texts: at most BUCKETS rows each."""
    s, t = ({r.bucket: r.n for r in totals.collect()} for totals in (source, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    ratio = lambda b: float(t.get(b, 0) + 1) * float(big_s + BUCKETS) / (float(s.get(b, 0) + 1) * float(big_t + BUCKETS))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(BUCKETS)]


def weights(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of each document's features."""

    def run(batches):
        trie = Trie(gain)
        for batch in pieces(batches):
            rows = [trie.walk(text) for text in encoded(batch)]
            n = [k for k, _ in rows]
            features = [max(2 * k - 1, 0) for k in n]
            weight = [total // f if f else 0 for (_, total), f in zip(rows, features, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return as_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words long, n_features long, weight long")


def with_score(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """With score: the weight and Gumbel noise from a digest of doc_id, in whole thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return weighted.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0))))


def ranked(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """With rank: 1, 2, ... for the floor(percent * N / 100) highest scores of the N documents with at least so many words, null for others.

    Scores are whole numbers in a range that the formulas bound (a few ten thousands), so the count by score is a small table: it tells
    where each score's ranks begin, and only documents of one score, which the noise spreads, are put in order together."""
    able = F.col("n_words") >= least
    by_score = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    begins = by_score.select("score", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("able"))
    begins = begins.withColumn("most", F.floor(F.col("able") * percent / 100)).where("above < most").select("score", "above", "most")
    cut = begins.agg(F.min("score").alias("cut")).first()["cut"]
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    drawn = able & (F.col("score") >= cut)
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    place = F.col("above") + F.row_number().over(within)
    inside = scored.where(drawn).join(F.broadcast(begins), "score").withColumn("rank", F.when(place <= F.col("most"), place).cast("long"))
    outside = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return inside.select(*outside.columns).unionByName(outside)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of all documents (doc_id, text), drawn towards the texts of target (text)."""
    gain = gains(bucket_totals(docs), bucket_totals(target))
    return ranked(with_score(saved(weights(docs, gain), "weights"), seed), percent, least)


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn documents' doc_ids and ranks, for joining with whatever columns a training set keeps."""
    return resample(docs, target, percent, least, seed).where("rank is not null").select("doc_id", "rank")
