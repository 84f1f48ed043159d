"""Repeated passages, exact, by suffix arrays of shards.

A byte is removed if a 50-byte string covers it that also starts in a document with a smaller identifier.

Every 50-byte string has an anchor: the least hash of the 24-byte strings in it. Equal strings have equal anchors, so a
text is cut into fragments of neighbouring strings with one anchor, and only fragments with equal anchors need to meet. Three
passes read the texts. The first finds the anchors that different texts share. The second sends the fragments with such anchors,
without their bytes: dealt and sorted by anchor, digest and identifier, they tell a stream which fragments are repeats as a whole,
and which (the first documents' ones, of anchors with several digests) may have strings in common with others. Only the latter are sent with
their bytes, by the third. Filters of fixed size tell a pass what the one before has found; what they let through in excess finds no partner.

Fragments with bytes are dealt and sorted by anchor and identifier and come in shards of
bounded size. In a shard equal fragments are joined; of anchors with several different ones a suffix array is made by
Larsson-Sadakane refinement (sorting only groups still equal, by the rank of what follows them) to a depth of 50 bytes, and the bytes
that neighbours have in common tell which 50-byte strings are equal. An anchor that goes on in the next shard takes its sorted strings along,
where later ones are found by binary search; as documents come in ascending order, only later ones can be repeats.
Anchors of more than MOST such fragments would gather too many strings in one task: their fragments are sent as single strings, each
dealt by its own hash instead of the anchor, so only equal strings have to meet. Known repeats are dealt by text and place.

Texts are known by 64-bit hashes (among a billion texts, two different ones share a hash with a probability of 3 in 100), fragments
by their anchor's and their own. Equal texts are handled once: all but the least document's are repeats throughout.

Defined results: a null text is empty; a text of fewer than 50 bytes keeps all; rows with equal identifiers are no repeats of
one another; a null identifier comes after all others; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.llm.arrays import PLACES, Recent, as_arrow, freed, mix, pieces, saved, utf8
from urbangraph.llm.jaccard import bit_filter, has_bit

LENGTH, GRAM = 50, 24
#: Strings of one fragment, and bytes of one shard's fragments.
STRINGS, SHARD = 64, 1 << 20
#: Texts and fragments that a task remembers as sent.
REMEMBERED = 200_000
FILTER_BITS = 27
#: Fragments of an anchor that may meet in one task; the filter of the anchors beyond.
MOST, MANY_BITS = 5_000, 24
LAST = (1 << 63) - 1

SENT = "anchor long, doc long, text_id long, start int, strings int, body binary"
FLAGS = "text_id long, doc long, start int, strings int"
BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def fragments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start in data, number of strings) of all fragments."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none, none, none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = mix(sum((eight[k : n - GRAM + 1 + k] * PLACES[k] for k in range(8, GRAM, 8)), eight[: n - GRAM + 1] * PLACES[0]))
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < width:
        h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
    whole = np.ones(len(h), bool)  # strings that don't run into the next text
    for d in range(1, LENGTH):
        at = offsets[1:-1] - d
        whole[at[(at >= 0) & (at < len(h))]] = False
    begin = whole.copy()
    begin[1:] &= (h[1:] != h[:-1]) | ~whole[:-1]
    begin[offsets[:-1][offsets[:-1] < len(h)]] = whole[offsets[:-1][offsets[:-1] < len(h)]]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return none.view(np.uint64), none, none, none
    total = np.concatenate([[0], np.cumsum(whole)])
    size = total[np.append(starts[1:], len(h))] - total[starts]
    parts = -(-size // STRINGS)
    if (parts > 1).any():
        place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(size, parts) - place * STRINGS
        starts, size = np.repeat(starts, parts) + place * STRINGS, np.minimum(left, STRINGS)
    return h[starts], np.searchsorted(offsets, starts, "right") - 1, starts, size


def suffix_array(key: np.ndarray, after: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The order of all suffixes by their first `depth` bytes at least, equal ones by place. key: the first 7 bytes of each suffix
    as a number; after[i]: how many bytes suffix i has. Each round sorts the suffixes still equal to others by the rank of what
    follows, twice as far on."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    begin = np.ones(n, bool)
    begin[1:] = sorted_key[1:] != sorted_key[:-1]
    rank, known = np.empty(n, np.int64), 7
    rank[order] = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    while known < min(depth, after.max()):
        alone = begin & np.append(begin[1:], True)
        places = np.flatnonzero(~alone)
        if not len(places):
            break
        some = order[places]
        follow = np.where(after[some] > known, rank[np.minimum(some + known, n - 1)] + 1, 0)
        both = rank[some] * (n + 2) + follow
        again = np.argsort(both, kind="stable")
        order[places], both = some[again], both[again]
        new = np.ones(len(places), bool)
        new[1:] = both[1:] != both[:-1]
        begin[places] = new
        rank[order[places]] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        known *= 2
    return order


def common_prefixes(data: np.ndarray, after: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place in the order whether the suffix has its first `length` bytes in common with the one before, by eight bytes at a time."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    long = after[order] >= length
    at = np.flatnonzero(long[1:] & long[:-1]) + 1
    for k in (*range(0, length - 8, 8), length - 8):
        at = at[eight[order[at] + k] == eight[order[at - 1] + k]]
    out = np.zeros(len(order), bool)
    out[at] = True
    return out


def strings_of(bodies: list[bytes]) -> np.ndarray:
    """All 50-byte strings of the bodies; a last byte keeps numpy from cutting off zeros."""
    rows = [np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint8), LENGTH) for b in bodies]
    rows = np.concatenate(rows)
    return np.concatenate([rows, np.ones((len(rows), 1), np.uint8)], 1).copy().view(f"S{LENGTH + 1}").ravel()


class Carried:
    """Sorted strings, each with its least document, of the anchor that goes on in the next shard."""

    def __init__(self):
        self.anchor, self.strings, self.docs = None, np.zeros(0, f"S{LENGTH + 1}"), np.zeros(0, np.int64)

    def least(self, strings: np.ndarray) -> np.ndarray:
        """By binary search; LAST if a string isn't there."""
        if not len(self.strings):
            return np.full(len(strings), LAST)
        at = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
        return np.where(self.strings[at] == strings, self.docs[at], LAST)

    def add(self, anchor: int, strings: np.ndarray, docs: np.ndarray) -> None:
        if anchor != self.anchor:
            self.__init__()
        strings, docs = np.concatenate([self.strings, strings]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, strings))
        strings, docs = strings[order], docs[order]
        new = np.ones(len(strings), bool)
        new[1:] = strings[1:] != strings[:-1]
        self.anchor, self.strings, self.docs = anchor, strings[new], docs[new]


def least_documents(bodies: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each string of each body the least document of those bodies that have it."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(bodies), np.uint8)
    after = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    key = np.zeros(len(data), np.int64)
    wide = np.append(data, np.zeros(7, np.uint8)).astype(np.int64)
    for i in range(7):
        key = key << 9 | np.where(after > i, wide[i : i + len(data)] + 1, 0)
    order = suffix_array(key, after)
    same = common_prefixes(data, after, order)
    group = np.cumsum(~same) - 1
    of = np.repeat(docs, sizes)[order]
    least = np.full(int(group[-1]) + 1, LAST)
    np.minimum.at(least, group, np.where(after[order] >= LENGTH, of, LAST))
    out = np.empty(len(data), np.int64)
    out[order] = least[group]
    return [out[s : s + n - LENGTH + 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def shard(anchor: np.ndarray, doc: np.ndarray, bodies: list[bytes], carried: Carried, goes_on: bool) -> list[np.ndarray | None]:
    """For each row which of its strings are repeats (None: none). Rows come by anchor, then document."""
    groups: dict[tuple[int, bytes], int] = {}
    of = np.fromiter((groups.setdefault((a, b), len(groups)) for a, b in zip(anchor.tolist(), bodies, strict=True)), np.int64, len(bodies))
    keys = list(groups)
    first = np.full(len(keys), LAST)
    np.minimum.at(first, of, doc)
    anchors = np.fromiter((k[0] for k in keys), np.int64, len(keys))
    least: list[np.ndarray] = [np.full(len(k[1]) - LENGTH + 1, f) for k, f in zip(keys, first.tolist(), strict=True)]
    several = np.flatnonzero(np.bincount(np.unique(anchors, return_inverse=True)[1])[np.unique(anchors, return_inverse=True)[1]] > 1)
    if len(several):
        for i, x in zip(several.tolist(), least_documents([keys[i][1] for i in several.tolist()], first[several]), strict=True):
            least[i] = x
    if carried.anchor is not None:
        for i in np.flatnonzero(anchors == carried.anchor).tolist():
            least[i] = np.minimum(least[i], carried.least(strings_of([keys[i][1]])))
    if goes_on:
        ends = np.flatnonzero(anchors == anchor[-1]).tolist()
        carried.add(int(anchor[-1]), strings_of([keys[i][1] for i in ends]), np.concatenate([least[i] for i in ends]))
    else:
        carried.__init__()
    return [x if (x := least[g] < d).any() else None for g, d in zip(of.tolist(), doc.tolist(), strict=True)]


def shared_anchors(docs: DataFrame) -> DataFrame:
    """anchor: those that different texts have."""

    def run(batches):
        recent = Recent()
        for batch in pieces(batches):
            ids = batch.column("text_id").to_numpy()
            fresh = recent.fresh(ids)
            anchor, text, _, _ = fragments(*utf8(batch.column("text").take(pa.array(fresh))))
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor.view(np.int64)), "text_id": pa.array(ids[fresh][text])})

    found = as_arrow(docs.select("text_id", "text"), run, "anchor long, text_id long")
    return found.groupBy("anchor").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high")).where("low < high").select("anchor")


class Copies:
    """Which copies of a text come in the order of ever smaller documents: later ones are repeats as a whole."""

    def __init__(self):
        self.least: dict[int, int] = {}

    def smaller(self, ids: np.ndarray, docs: np.ndarray) -> np.ndarray:
        out = []
        for t, d in zip(ids.tolist(), docs.tolist(), strict=True):
            before = self.least.get(t, LAST + 1)
            out.append(d < before)
            self.least[t] = min(d, before)
        if len(self.least) > REMEMBERED:
            self.least.clear()
        return np.array(out, bool)


def contents(data: np.ndarray, start: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Digests of fragments: polynomials of their bytes."""
    power = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * power[0][:-1])])
    return mix((total[start + strings + LENGTH - 1] - total[start]) * power[1][start] + strings.astype(np.uint64))


def place_of(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64) + start.astype(np.uint64) * PLACES[9])


def met(docs: DataFrame, packed) -> DataFrame:
    """Runs that are repeats as a whole, and those (`open`) that may be in part: anchor long, text_id, doc, start, strings, open boolean, place (a digest)."""

    def send(batches):
        copies = Copies()
        for batch in pieces(batches):
            ids, doc = batch.column("text_id").to_numpy(), batch.column("doc").to_numpy()
            some = copies.smaller(ids, doc)
            batch, ids, doc = batch.filter(pa.array(some)), ids[some], doc[some]
            data, offsets = utf8(batch.column("text"))
            anchor, text, start, strings = fragments(data, offsets)
            keep = has_bit(packed.value, anchor, FILTER_BITS)
            anchor, text, start, strings = anchor[keep], text[keep], start[keep], strings[keep]
            made = {"anchor": anchor.view(np.int64), "content": contents(data, start, strings).view(np.int64), "doc": doc[text], "text_id": ids[text], "start": (start - offsets[text]).astype(np.int32), "strings": strings.astype(np.int32)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in made.items()})

    def settle(batches):
        last = [None, None, 0, 0]  # of the row before: anchor, content, the content's least document, contents of the anchor so far
        waiting: list[pa.RecordBatch] = []  # first rows of an anchor that has had one content so far
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, content, doc = (batch.column(c).to_numpy() for c in ("anchor", "content", "doc"))
            new = np.append(anchor[0] != last[0], anchor[1:] != anchor[:-1])
            other = new | np.append(content[0] != last[1], content[1:] != content[:-1])
            begin = np.maximum.accumulate(np.where(other, np.arange(len(doc)), -1))
            first = np.where(begin >= 0, doc[begin], last[2])
            group, nth = np.cumsum(new), np.cumsum(other)  # group 0: the anchor of the batch before
            starts = np.append(-last[3], nth[new] - 1)
            count = nth - starts[group]
            ends = np.searchsorted(group, np.arange(group[-1] + 1), "right") - 1
            several, lead = count[ends][group] > 1, doc == first
            if not new[0] and count[ends[0]] > 1:
                yield from waiting
            if new[0] or count[ends[0]] > 1 or group[-1]:
                waiting = []
            places = place_of(batch.column("text_id").to_numpy(), batch.column("start").to_numpy())
            rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("anchor", "text_id", "doc", "start", "strings")), pa.array(lead), pa.array(places.view(np.int64))], ["anchor", "text_id", "doc", "start", "strings", "open", "place"])
            yield rows.filter(pa.array(~lead | several))
            held = lead & ~several & (group == group[-1])
            if held.any():
                waiting.append(rows.filter(pa.array(held)))
            last = [anchor[-1], content[-1], first[-1], count[-1]]

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = as_arrow(docs.select("doc", "text_id", "text"), send, "anchor long, content long, doc long, text_id long, start int, strings int")
    return as_arrow(rows.repartition(parts, "anchor").sortWithinPartitions("anchor", "content", "doc"), settle, "anchor long, text_id long, doc long, start int, strings int, open boolean, place long")


def sent(docs: DataFrame, packed, opened, many) -> DataFrame:
    """The open fragments, those of anchors in many string by string, and (without a body) those known to be repeats."""

    def run(batches):
        copies = Copies()
        least: dict[int, int] = {}
        for batch in pieces(batches):
            ids, doc = batch.column("text_id").to_numpy(), batch.column("doc").to_numpy()
            fresh = copies.smaller(ids, doc)
            batch, ids, doc = batch.filter(pa.array(fresh)), ids[fresh], doc[fresh]
            data, offsets = utf8(batch.column("text"))
            anchor, text, start, strings = fragments(data, offsets)
            some = has_bit(packed.value, anchor, FILTER_BITS) & has_bit(opened.value, place_of(ids[text], start - offsets[text]), FILTER_BITS)
            anchor, text, start, strings = anchor[some], text[some], start[some], strings[some]
            if not len(anchor):
                continue
            raw = data.tobytes()

            def part(anchor, text, start, strings, data=data, raw=raw, doc=doc, ids=ids, offsets=offsets, by_string=False):
                """A batch, and which rows have a body; by_string: rows are single strings, dealt by their hashes."""
                content = contents(data, start, strings)
                anchor = content if by_string else anchor
                bodies = []
                for c, d, s, n in zip(content.tolist(), doc[text].tolist(), start.tolist(), strings.tolist(), strict=True):
                    before = least.get(c)
                    if before is not None and before < d:
                        bodies.append(None)
                        continue
                    if before is None or d < before:
                        least[c] = d
                    bodies.append(raw[s : s + n + LENGTH - 1])
                new = np.fromiter((x is not None for x in bodies), bool, len(bodies))
                anchor = np.where(new, anchor, mix(ids[text].view(np.uint64) + (start - offsets[text]).astype(np.uint64)))
                columns = {"anchor": pa.array(anchor.view(np.int64)), "doc": pa.array(doc[text]), "text_id": pa.array(ids[text]), "start": pa.array((start - offsets[text]).astype(np.int32)), "strings": pa.array(strings.astype(np.int32)), "body": pa.array(bodies, pa.binary())}
                return pa.RecordBatch.from_pydict(columns), new

            batch, new = part(anchor, text, start, strings)
            split = new & has_bit(many.value, anchor, MANY_BITS)
            yield batch.filter(pa.array(~split))
            if split.any():
                size = strings[split]
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                yield part(None, np.repeat(text[split], size), np.repeat(start[split], size) + step, np.ones(len(step), np.int64), by_string=True)[0]
            if len(least) > REMEMBERED:
                least.clear()

    return as_arrow(docs.select("doc", "text_id", "text"), run, SENT)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, n of each."""
    if len(_powers[0]) < n:
        base = int(PLACES[3])
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]))
    return [p[:n] for p in _powers]


def runs_of(flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(array, start, length) of each run of true values."""
    gap = np.zeros(1, bool)
    change = np.diff(np.concatenate([part for x in flags for part in (gap, x)] + [gap]).astype(np.int8))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    first = np.cumsum([0] + [len(x) + 1 for x in flags[:-1]])
    row = np.searchsorted(first, begin, "right") - 1
    return row, begin - first[row], end - begin


def repeats(fragments: DataFrame) -> DataFrame:
    """text_id, doc, start, strings: runs of strings that start in a smaller document too."""

    def solve(rows: list[pa.RecordBatch], carried: Carried, goes_on: bool):
        table = pa.Table.from_batches(rows).combine_chunks()
        known = table.filter(table.column("body").is_null())
        if known.num_rows:
            yield from known.select(["text_id", "doc", "start", "strings"]).to_batches()
        table = table.filter(table.column("body").is_valid())
        if not table.num_rows:
            return
        anchor, doc, ids, start = (table.column(c).to_numpy() for c in ("anchor", "doc", "text_id", "start"))
        flags = shard(anchor, doc, table.column("body").to_pylist(), carried, goes_on)
        some = np.array([i for i, x in enumerate(flags) if x is not None], np.int64)
        if len(some):
            row, begin, size = runs_of([flags[i] for i in some.tolist()])
            row = some[row]
            columns = {"text_id": ids[row], "doc": doc[row], "start": (start[row] + begin).astype(np.int32), "strings": size.astype(np.int32)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, carried = 0, Carried()
        for batch in pieces(batches, "body", SHARD // 4):
            if size >= SHARD:  # held back until it's known whether the last anchor goes on
                yield from solve(held, carried, batch.column("anchor")[0] == held[-1].column("anchor")[-1])
                held, size = [], 0
            held.append(batch)
            size += batch.column("body").nbytes
        if held:
            yield from solve(held, carried, False)

    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return as_arrow(fragments.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc"), run, FLAGS)


def cut(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """text_id, n_removed, n_spans, kept binary, of the texts that flags (text_id, runs) name."""
    packed = docs.sparkSession.sparkContext.broadcast(bit_filter(flags.select("text_id"), "text_id", 24))  # 2 MB

    def pick(batches):
        for batch in pieces(batches):
            some = np.flatnonzero(has_bit(packed.value, batch.column("text_id").to_numpy(), 24))
            if len(some):
                yield batch.take(pa.array(some))

    def run(batches):
        for batch in pieces(batches):
            removed, spans, kept = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                start, strings = (runs.values.field(c).to_numpy() for c in ("start", "strings"))
                np.add.at(edge, start, 1)
                np.add.at(edge, start + strings + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_pydict({"text_id": batch.column("text_id"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    picked = as_arrow(docs.select("text_id", "text"), pick, "text_id long, text string").groupBy("text_id").agg(F.min("text").alias("text"))
    return as_arrow(picked.join(flags, "text_id").select("text_id", "text", "runs"), run, "text_id long, n_removed long, n_spans long, kept binary")


def dedup(df: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept binary (the remaining bytes)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = df.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_id"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"))
    spark = df.sparkSession
    shared = saved(shared_anchors(docs), "anchors")
    packed = spark.sparkContext.broadcast(bit_filter(shared, "anchor", FILTER_BITS))  # 16 MB
    found = saved(met(docs, packed), "met")
    freed(shared)
    opened = spark.sparkContext.broadcast(bit_filter(found.where("open"), "place", FILTER_BITS))  # 16 MB
    counts = found.where("open").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST)
    many = spark.sparkContext.broadcast(bit_filter(counts, "anchor", MANY_BITS))  # 2 MB
    part = saved(repeats(sent(docs, packed, opened, many)), "repeats")
    flags = found.where("not open").select("text_id", "doc", "start", "strings").union(part)
    classes = saved(docs.groupBy("text_id").agg(F.min("doc").alias("first")), "classes")
    runs = flags.groupBy("text_id", "doc").agg(F.collect_list(F.struct("start", "strings")).alias("runs"))  # a text's own runs
    runs = saved(runs.join(classes, (runs["text_id"] == classes["text_id"]) & (runs["doc"] == classes["first"])).select(runs["text_id"], "runs"), "runs")
    freed(found, part)
    results = cut(docs, runs)
    if not keep_text:
        results = results.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    else:
        results = results.withColumn("kept_sha256", F.sha2("kept", 256))
    results = saved(results, "cut")
    rows = docs.select("doc_id", "doc", "text_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), *([F.encode("text", "UTF-8").alias("bytes")] if keep_text else []))
    rows = rows.join(classes, "text_id").join(results, "text_id", "left")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(F.col("doc") > F.col("first"), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).when(F.col("doc") > F.col("first"), 0).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(F.col("doc") > F.col("first"), F.col("sha")).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).when(F.col("doc") > F.col("first"), F.col("bytes")).otherwise(F.coalesce("kept", "bytes")).alias("kept")] if keep_text else []),
    )
