"""Operator 11: conversations for training out of trees of replies.

Messages name the one they reply to. Self-joins that double their reach (each message's jump goes to its jump's jump) find every message's
root, depth and mean score in as many rounds as the logarithm of the longest chain, and enumerate the messages of each chosen path from leaf to
root. Branches of a tree are ranked by the mean score along the path, ties by the leaf's id, and each chosen path is formatted as one
conversation with a loss mask over what the assistant says.

A message without an id is known by its content; of rows with one id the least by (parent, score, role, text) counts. A parent that isn't
there makes its reply a root. Messages that reply to each other in a circle, or to such, have no root and hence no path: they are in no
conversation. Null roles and texts are empty, null scores 0. Empty tables give empty results. A conversation is one value, built in a task that
reads its messages in order and holds one conversation at a time; a message that many reply to is split over SPREAD keys of the join."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.llm.arrays import as_arrow, saved, small

#: Messages with more replies (or jumps) than MANY are joined under SPREAD keys.
MANY, SPREAD = 10_000, 64


@dataclass(frozen=True)
class Template:
    """A turn is begin + role + middle + text + end. Control strings inside roles and texts get MARK after their first character, once more for
    each that is there already, so that they can be told from the template's own and taken back."""

    begin: str = "<s>"
    middle: str = "[INST] "
    end: str = "</s>"
    #: What a model may take for a control string; begin, middle (without its space) and end are among them.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    assistant: str = "assistant"
    mark: str = "\\"
    found: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if {self.begin, self.middle.strip(), self.end} - set(self.controls):
            raise ValueError("the template's own marks have to be among its control strings")
        if any(a[i:] and (a[i:].startswith(b) or b.startswith(a[i:])) for a in self.controls for b in self.controls for i in range(1, len(a))):
            raise ValueError("control strings must not overlap one another")
        if any(self.mark in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more, none of them the mark")
        marks = f"{re.escape(self.mark)}*"
        object.__setattr__(self, "found", re.compile("|".join(re.escape(c[0]) + marks + re.escape(c[1:]) for c in self.controls)))

    def escape(self, text: str) -> str:
        return self.found.sub(lambda m: m[0][0] + self.mark + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.found.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == self.mark else m[0], text)

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """(text, loss mask): the mask has the code points [start, end) of each text of the assistant."""
        parts, mask, at = [], [], 0
        for role, text in turns:
            head, body = self.begin + self.escape(role) + self.middle, self.escape(text)
            if role == self.assistant:
                mask.append((at + len(head), at + len(head) + len(body)))
            parts += head, body, self.end
            at += len(head) + len(body) + len(self.end)
        return "".join(parts), mask

    def parse(self, text: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        turns = []
        for turn in text.split(self.end)[:-1]:
            if not turn.startswith(self.begin):
                raise ValueError("a turn without its beginning")
            role, _, body = turn[len(self.begin) :].partition(self.middle)
            turns.append((self.unescape(role), self.unescape(body)))
        return turns

    def learned(self, text: str, mask: list[tuple[int, int]]) -> str:
        """All text under the loss mask, in order."""
        return "".join(self.unescape(text[a:b]) for a, b in mask)


def prepared(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, parent (null where there is none such), score, role, text and the columns in keep, one row for each id."""
    role, text, score = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    named = messages.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), score.alias("score"), role.alias("role"), text.alias("text"), F.struct(F.lit(0).alias("none"), *keep).alias("kept"))
    content = F.concat(F.lit("content "), F.sha2(F.to_json(F.struct("parent", "score", "role", "text")), 256))
    values = F.struct("parent", "score", "role", "text", "kept")
    rows = saved(named.withColumn("id", F.coalesce("id", content)).groupBy("id").agg(F.min(values).alias("m")).select("id", "m.*"), "messages")
    there = meet(rows.where("parent is not null").select("id", "parent"), "parent", rows.select(F.col("id").alias("key")))
    parents = there.select("id", F.col("key").alias("known"))
    return rows.join(parents, "id", "left").withColumn("parent", F.col("known")).drop("known")


def meet(many: DataFrame, column: str, one: DataFrame) -> DataFrame:
    """The rows of both where many's column equals one's key, which is unique: inner join. Keys that MANY rows or more name are split over SPREAD
    keys, under each of which one's row stands."""
    heavy = many.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY).select("key", F.lit(True).alias("heavy"))
    heavy = saved(heavy, "heavy")
    if not heavy.take(1):
        return many.join(one, many[column] == one["key"])
    heavy = small(heavy)
    pick = F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(0).cast("int")
    left = many.join(heavy.withColumnRenamed("key", column), column, "left").withColumn("part", pick).drop("heavy")
    parts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(heavy, "key", "left").withColumn("r_part", F.explode(parts)).drop("heavy")
    return left.join(right, (left[column] == right["key"]) & (left["part"] == right["r_part"])).drop("part", "r_part")


def jumps(links: DataFrame) -> list[DataFrame]:
    """After each round: id, top (the message 2 to the power of the round above it, or its root if that is nearer), steps to it, total (the
    scores on the way, a root's with it) and done (top is its root). links: id, parent, score."""
    root = F.col("parent").isNull()
    levels = [saved(links.select("id", F.coalesce("parent", "id").alias("top"), F.when(root, 0).otherwise(1).cast("long").alias("steps"), F.col("score").alias("total"), root.alias("done")), "jumps")]
    n, reach = levels[0].count(), 1
    while reach <= n and levels[-1].where(~F.col("done")).take(1):
        now = levels[-1]
        tops = now.select(F.col("id").alias("key"), F.col("top").alias("further"), F.col("steps").alias("more"), F.col("total").alias("added"), F.col("done").alias("ends"))
        moved = meet(now.where(~F.col("done")), "top", tops).select("id", F.col("further").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("added")).alias("total"), F.col("ends").alias("done"))
        levels.append(saved(now.where("done").unionByName(moved), "jumps"))
        reach *= 2
    return levels


def branches(links: DataFrame, levels: list[DataFrame], best: int) -> DataFrame:
    """leaf, root, depth, score, rank of the best branches of each tree."""
    inner = links.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    leaves = levels[-1].where("done").join(inner, "id", "left_anti").select(F.col("id").alias("leaf"), F.col("top").alias("root"), F.col("steps").alias("depth"), (F.col("total") / (F.col("steps") + 1)).alias("score"))
    order = Window.partitionBy("root").orderBy(F.desc("score"), "leaf")
    return leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def members(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """leaf, place (0 at the root), id of the messages on each chosen path: each round adds those that lie as far above the ones known as these
    lie above the leaf at most."""
    rows = saved(chosen.select("leaf", F.col("leaf").alias("id"), F.col("depth").alias("place")), "members")
    for k, level in enumerate(levels):
        step = 1 << k
        nexts = level.where(F.col("steps") == step).select(F.col("id").alias("key"), "top")
        above = rows.where(F.col("place") >= step).withColumnRenamed("id", "node").withColumn("id", F.col("leaf"))
        if not above.take(1):
            continue
        further = meet(above, "node", nexts).select("leaf", F.col("top").alias("id"), (F.col("place") - step).alias("place"))
        rows = saved(rows.unionByName(further), "members")
    return rows


def formatted(paths: DataFrame, template: Template) -> DataFrame:
    """leaf, kept (of the first message), text, mask of paths (leaf, place, role, text, kept)."""
    kind = paths.schema["kept"].dataType.simpleString()

    def run(batches):
        leaf, kept, turns, schema = None, None, [], None
        for batch in batches:
            schema = batch.schema
            out = []
            columns = [batch.column(c).to_pylist() for c in ("leaf", "role", "text")]
            for row, (name, role, text) in enumerate(zip(*columns, strict=True)):
                if name != leaf:
                    if turns:
                        out.append((leaf, kept, *template.format(turns)))
                    leaf, kept, turns = name, batch.column("kept")[row].as_py(), []
                turns.append((role, text))
            yield rows(out, schema)
        if turns:
            yield rows([(leaf, kept, *template.format(turns))], schema)

    def rows(out, schema):
        mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        spans = [[{"start": a, "end": b} for a, b in m] for *_, m in out]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], schema.field("kept").type), pa.array([x[2] for x in out], pa.string()), pa.array(spans, mask)], ["leaf", "kept", "text", "mask"])

    ordered = paths.select("leaf", "place", "role", "text", "kept").repartition("leaf").sortWithinPartitions("leaf", "place")
    return as_arrow(ordered, run, f"leaf string, kept {kind}, text string, mask array<struct<start:long,end:long>>")


def conversations(messages: DataFrame, best: int = 1, template: Template = Template(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """leaf, root, depth, score, rank, text, mask and the columns in keep (of the root): the best branches of each tree of messages (id, parent,
    role, text, score), one conversation each."""
    nodes = saved(prepared(messages, keep), "nodes")
    levels = jumps(nodes.select("id", "parent", "score"))
    chosen = saved(branches(nodes, levels, best), "branches")
    on_path = members(chosen, levels).withColumnRenamed("id", "node").withColumn("id", F.col("leaf"))
    paths = meet(on_path, "node", nodes.select(F.col("id").alias("key"), "role", "text", "kept"))
    texts = formatted(paths, template)
    return chosen.join(texts, "leaf").select("leaf", "root", "depth", "score", "rank", "text", "mask", *(F.col(f"kept.{c}") for c in keep))


def chains(conversations: DataFrame) -> DataFrame:
    """Messages (id, parent, role, text, score, conv_id) of conversations given as rows by turn: each replies to the row before. Null turns
    come first, rows of one turn in the order of role and text; rows without a conv_id are one conversation."""
    within = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select(F.col("conv_id").cast("long"), "role", "text", F.row_number().over(within).alias("k"))
    name = lambda k: F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), k.cast("string"))
    return numbered.select(name(F.col("k")).alias("id"), F.when(F.col("k") > 1, name(F.col("k") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"), "conv_id")


def digests(texts: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted texts and their masks."""
    import hashlib

    def run(batches):
        for batch in batches:
            out = []
            for text, mask in zip(batch.column("text").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns, learned = template.parse(text), template.learned(text, [(m["start"], m["end"]) for m in mask])
                said = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
                out.append((len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return as_arrow(texts.select("conv_id", "text", "mask"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
