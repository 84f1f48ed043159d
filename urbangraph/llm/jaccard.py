"""N-gram Jaccard join by partitions of the universe of shingles, exact.

Sets. A document's set is that of its k-word shingles, as 64-bit hashes; documents with equal 64-bit digests of their sets
are one set (among a billion sets, two different ones share a digest with a probability of 3 in 100). Sets fall into size
bands; two sets that may link meet in the band of the larger one, so a set stands in its own band and, where a partner could
be larger than its band, in the next.

Pigeonhole. In a band whose sets can differ in at most H shingles, shingles are dealt by hash to m segments. Linked sets
have at least m - H equal segments, and if one of them has e empty ones, at least m - H - e equal filled ones. `plain`
plans index a hash of each segment's subset. `near` plans use fewer segments and also index each subset without one of
its shingles: segments then differ only by two shingles or more, so at most H / 2 differ. `single` indexes every shingle
alone. A first pass finds for each set its slack by each plan: how many signatures more than one it must share with any partner.

Allocation. A plain plan misses a pair only if both sets have a negative slack, too many empty segments. Each band takes the
plan of least index entries, counting that such odd sets are indexed by a second plan as well, among themselves: `near` where that
holds for all of them, else `single`. A few odd sets thus cost their own entries only, and the index grows as the input.

Cost. As linked sets share more signatures than the slack of either, each set gives up as many of those that it shares with others
as its slack allows, the most frequent first, in one order for all: of a pair's common signatures the least frequent one stays
with both. So common passages, whose signatures are frequent, don't make candidates, and no link is lost.

Stars. Entries are dealt and sorted by signature, so that a stream finds those that several sets share. A signature's leader is
the set that shares most signatures with others. Each set is compared with all leaders of its signatures, which gives links
and, for each leader, how its sets differ from it: by the shingles gained and lost. Connected sets need no more tests.

Differences. Two sets of one leader that still lie in different components link only if their differences from the leader have
so many shingles in common that `|D(x)| + |D(y)| - 2 common` is small enough: the leader's part cancels. Pigeonhole again, on the
differences: taken in one order (rare ones first, gained before lost), the two must share a shingle among the first
`|D| - common + 1` of both. As at most one of the two is linked with the leader, most of a near copy's own changes
are rare, and so are candidates, also among thousands of near copies just below the threshold. They are verified on the differences.

Turns. The entries of the index, and the texts that are compared, are the most that is dealt out at once. With `passes` above 1 they
are dealt in so many turns, by signature and by set: each turn reads all texts and its shuffle goes before the next one begins. Links and
results are the same; the price is that texts are read and cut into shingles once more for each turn.

Verification counts common 64-bit shingle hashes of the whole texts.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; with fewer than k words
the whole word sequence is the one shingle; repeated rows keep their rows and link if they have words; a null doc_id
takes part and never names a component unless it is alone; an empty table gives an empty table; further columns are not read,
and `distinct` passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.llm.arrays import LOWER, PLACES, Recent, as_arrow, freed, keyed, mix, pieces, saved, small, utf8, word_hashes, words

#: Each size band ends where this times its start is reached.
BAND = 1.25
#: Empty segments that plain plans leave room for, and those of near plans.
ROOM, NEAR_ROOM = (6, 16), (8,)
#: Bits of the filter that tells which documents a later pass needs; what it lets through in excess is dropped by a join.
FILTER_BITS = 24
#: Differences that so many sets of a leader share come last; bits of the filter that knows them, which only decides on the order.
OFTEN, OFTEN_BITS = 8, 26

SETS = "doc_id long, a long, n_shingles long"


def sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, where each text's begin with one more for the end)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    count = np.diff(first)
    shingles = np.zeros(0, np.uint64)
    if len(h) >= k:
        rolling = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            rolling += h[j : len(h) - k + 1 + j] * PLACES[j]
        shingles = mix(rolling)
    doc = np.repeat(np.arange(n), np.maximum(count - k + 1, 0))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(count - k + 1, 0)) - np.maximum(count - k + 1, 0), np.maximum(count - k + 1, 0)) + first[:-1][doc]
    shingles = shingles[at]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.array([mix((h[first[d] : first[d + 1]] * PLACES[: count[d]]).sum(keepdims=True) + PLACES[100 + count[d]])[0] for d in short.tolist()], np.uint64)
        doc, shingles = np.concatenate([doc, short]), np.concatenate([shingles, whole])
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[new], np.searchsorted(doc[new], np.arange(n + 1))


def digests(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit sum of each set's shingles, mixed; 0 for empty sets."""
    n = np.diff(first)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ PLACES[200]))])
    return np.where(n > 0, mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)), 0).view(np.int64)


@lru_cache(4)
def band_starts(most: int = 1 << 40) -> np.ndarray:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


def differ(size: int, percent: int) -> int:
    """Most shingles in which linked sets differ, none of them larger than size: |r| + |s| - 2 overlap, overlap at least
    percent / (100 + percent) of |r| + |s|."""
    both = np.arange(max(2, 2 * size - 400), 2 * size + 1)  # the bound rises with |r| + |s|, but for rounding
    return int((both - 2 * -(-both * percent // (100 + percent))).max())


@lru_cache(4096)
def plans(band: int, percent: int) -> tuple[tuple[str, int, int], ...]:
    """(kind, segments, most empty ones) of the plans of a band, cheapest first by entries of a set at the band's end."""
    size = int(band_starts()[band + 1]) - 1
    most = differ(size, percent)
    found = [(most + 1 + room, "plain", most + 1 + room, room) for room in ROOM if most + 1 + room < size]
    found += [(size + half + room, "near", half + room, room // 2) for half in (most // 2 + 1,) for room in NEAR_ROOM if half + room < size]
    return tuple((kind, m, room) for _, kind, m, room in sorted(found)) + (("single", 0, 0),)


def bands(n: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(sets, band)] for the own band and the next one, where a partner may be in it."""
    own = np.searchsorted(band_starts(), n, "right") - 1
    larger = n * 100 // percent
    out, there = [(np.arange(len(n)), own)], np.flatnonzero(n > 0)
    step = 1
    while True:  # bands of small sizes are narrow: a partner may be several bands on
        some = there[larger[there] >= band_starts()[own[there] + step]]
        if not len(some):
            return out
        out.append((some, own[some] + step))
        there, step = some, step + 1


def segment_of(shingles: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """Segments in the order of hashes, so that a sorted set has each segment's subset in one run."""
    return ((shingles >> np.uint64(32)) * np.asarray(m, np.uint64)) >> np.uint64(32)


def filled(shingles: np.ndarray, doc: np.ndarray, docs: int, m: np.ndarray) -> np.ndarray:
    """Segments with a shingle, by set."""
    seg = segment_of(shingles, m[doc])
    new = np.ones(len(seg), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=docs)


def spread(shingles: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of some sets, index into `some`)."""
    n = np.diff(first)[some]
    doc = np.repeat(np.arange(len(some)), n)
    return shingles[np.arange(int(n.sum())) + np.repeat(first[some] - (np.cumsum(n) - n), n)], doc


def most_different(n: np.ndarray, band: np.ndarray, percent: int) -> np.ndarray:
    """Most shingles in which a set of n differs from a linked one, neither larger than the band."""
    partner = np.minimum(n * 100 // percent, band_starts()[band + 1] - 1)
    return np.maximum(*(np.where(both > 0, both - 2 * -(-both * percent // (100 + percent)), 0) for both in (n + partner, n + partner - 1)))


def slacks(shingles: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, band * 8 + plan, slack) of all sets, bands and plans, as two arrays: the set, and the others as columns."""
    owner, rows = [], []
    sizes = np.diff(first)
    for some, band in bands(sizes, percent):
        some, band = some[band >= 0], band[band >= 0]
        if not len(some):
            continue
        mine, doc = spread(shingles, first, some)
        n, different = sizes[some], most_different(sizes[some], band, percent)
        options = {b: plans(b, percent) for b in set(band.tolist())}
        for p in range(max(map(len, options.values()))):
            pick = np.flatnonzero(np.array([p < len(options[b]) for b in band.tolist()]))
            plan = [options[b][p] for b in band[pick].tolist()]
            m = np.ones(len(some), np.int64)
            m[pick] = [max(x[1], 1) for x in plan]
            empty = (m - filled(mine, doc, len(some), m))[pick]
            kind = np.array([x[0] for x in plan])
            room = np.array([x[2] for x in plan])
            slack = np.where(kind == "plain", m[pick] - different[pick] - 1 - empty, np.where(kind == "near", np.minimum(room - empty, 0), -(-n[pick] * percent // 100) - 1))
            owner.append(some[pick])
            rows.append(np.stack([band[pick] * 8 + p, slack]))
    if not owner:
        return np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    owner, rows = np.concatenate(owner), np.concatenate(rows, 1)
    order = np.argsort(owner, kind="stable")
    return owner[order], rows[:, order]


def tagged(h: np.ndarray, band: np.ndarray, second: int) -> np.ndarray:
    """A signature tells its band, and whether it is of the second plan, by its last 9 bits."""
    return h >> np.uint64(9) << np.uint64(9) | band << np.uint64(1) | np.uint64(second)


def signatures(shingles: np.ndarray, first: np.ndarray, percent: int, chosen: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of all sets in all their bands."""
    keys, owner = [], []
    sizes = np.diff(first)

    def index(some: np.ndarray, band: np.ndarray, plan: list, second: int) -> np.ndarray:
        """Adds the entries of one plan for each set; returns empty segments."""
        kind, m = np.array([x[0] for x in plan]), np.array([x[1] for x in plan])
        empty = np.zeros(len(some), np.int64)
        for this in ("plain", "near", "single"):
            pick = np.flatnonzero(kind == this)
            if not len(pick):
                continue
            mine, doc = spread(shingles, first, some[pick])
            salt, tag = mix(band[pick].astype(np.uint64) + PLACES[210]), band[pick].astype(np.uint64)
            if this == "single":
                keys.append(tagged(mix(mine + salt[doc]), tag[doc], second))
                owner.append(some[pick][doc])
                continue
            seg = segment_of(mine, m[pick][doc])
            new = np.ones(len(seg), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            empty[pick] = m[pick] - np.bincount(doc[at], minlength=len(pick))
            own = mix(mine ^ PLACES[211])
            total = np.add.reduceat(own, at)
            base = mix(seg[at] + np.uint64(1)) + salt[doc[at]]
            keys.append(tagged(mix(total + base), tag[doc[at]], second))
            owner.append(some[pick][doc[at]])
            if this == "near":
                of = np.cumsum(new) - 1
                size = np.diff(at, append=len(seg))
                less = np.flatnonzero(size[of] > 1)
                keys.append(tagged(mix((total[of] - own + base[of])[less]), tag[doc[less]], second))
                owner.append(some[pick][doc[less]])
        return empty

    for some, band in bands(sizes, percent):
        options = {b: plans(b, percent) for b in set(band.tolist())}
        last = {b: (len(x) - 1, len(x) - 1) for b, x in options.items()}
        plan = [options[b][chosen.get(b, last[b])[0]] for b in band.tolist()]
        empty = index(some, band, plan, 0)
        room = np.array([x[1] for x in plan]) - most_different(sizes[some], band, percent) - 1
        odd = np.flatnonzero((np.array([x[0] for x in plan]) == "plain") & (room < empty))
        if len(odd):
            index(some[odd], band[odd], [options[b][chosen.get(b, last[b])[1]] for b in band[odd].tolist()], 1)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owner)


def allocated(masks: dict[tuple[int, int], int], percent: int) -> dict[int, tuple[int, int]]:
    """The plan of each band and that of its odd sets, from the numbers of sets by band and by which plans (bits) leave
    them a negative slack."""
    chosen = {}
    for band in {b for b, _ in masks}:
        options, size = plans(band, percent), int(band_starts()[band + 1]) - 1
        sets_by = {mask: n for (b, mask), n in masks.items() if b == band}
        all_sets, costs = sum(sets_by.values()), []
        for p, (kind, m, _) in enumerate(options):
            odd = {mask: n for mask, n in sets_by.items() if mask >> p & 1}
            if kind == "near" and odd:
                continue
            second = next((q for q, x in enumerate(options) if x[0] == "near" and not any(mask >> q & 1 for mask in odd)), len(options) - 1)
            entries = {"plain": m, "near": m + size, "single": size}
            costs.append((all_sets * entries[kind] + sum(odd.values()) * entries[options[second][0]], p, second))
        chosen[band] = min(costs)[1:]
    return chosen


def describe(df: DataFrame, k: int, percent: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(doc_id, a: digest, n_shingles, slacks; the plans of each band)."""

    def run(batches):
        for batch in pieces(batches):
            shingles, first = sets(batch.column("text"), k)
            owner, rows = slacks(shingles, first, percent)
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1].astype(np.int32))], ["plan", "slack"]))
            which, of = np.unique(owner << 8 | rows[0] >> 3, return_inverse=True)
            mask = np.zeros(len(which), np.int64)
            np.bitwise_or.at(mask, of, np.where(rows[1] < 0, 1 << (rows[0] & 7), 0))
            masks = pa.ListArray.from_arrays(np.searchsorted(which >> 8, np.arange(batch.num_rows + 1)).astype(np.int32), pa.array(((which & 255) << 8 | mask).astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "a": pa.array(digests(shingles, first)), "n_shingles": pa.array(np.diff(first).astype(np.int64)), "slacks": lists, "masks": masks})

    found = saved(as_arrow(df, run, SETS + ", slacks array<struct<plan:int,slack:int>>, masks array<int>"), "sets")
    masks = found.select(F.explode("masks").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect()  # bands times sets of plans at most
    return found, allocated({(r["x"] >> 8, r["x"] & 255): r["n"] for r in masks}, percent)


def in_turns(make: Callable[[int], DataFrame], passes: int, name: str) -> DataFrame:
    """What all turns make; each is saved before the next begins, so that no two have shuffles on disk."""
    return reduce(DataFrame.union, [saved(make(turn), name) for turn in range(passes)])


def entries(df: DataFrame, k: int, percent: int, chosen: dict[int, tuple[int, int]], passes: int = 1, turn: int = 0) -> DataFrame:
    """signature long, a long: index entries of each distinct set, mostly once from each task; those of one turn alone."""

    def run(batches):
        recent = Recent()
        for batch in pieces(batches):
            shingles, first = sets(batch.column("text"), k)
            a = digests(shingles, first)
            some = recent.fresh(a)
            mine, doc = spread(shingles, first, some)
            keys, owner = signatures(mine, np.searchsorted(doc, np.arange(len(some) + 1)), percent, chosen)
            if passes > 1:
                mine = (keys >> np.uint64(32)) % np.uint64(passes) == turn
                keys, owner = keys[mine], owner[mine]
            yield pa.RecordBatch.from_pydict({"signature": pa.array(keys.view(np.int64)), "a": pa.array(a[some][owner])})

    return as_arrow(df.select("text"), run, "signature long, a long")


def led(index: DataFrame) -> DataFrame:
    """signature, a, leader: the entries of signatures that several sets share, with the least set of each."""

    def run(batches):
        last_key = last_a = leader = None
        for batch in batches:
            key, a = batch.column("signature").to_numpy(), batch.column("a").to_numpy()
            new = np.ones(len(key), bool)
            if len(key):
                new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1])
                new[0] = last_key is None or key[0] != last_key or a[0] != last_a
            key, a = key[new], a[new]
            if not len(key):
                continue
            begin = np.ones(len(key), bool)
            begin[1:] = key[1:] != key[:-1]
            at = np.where(begin, np.arange(len(key)), 0)
            lead = a[np.maximum.accumulate(at)]
            if last_key is not None and key[0] == last_key:
                run_end = int(np.flatnonzero(begin[1:])[0]) + 1 if begin[1:].any() else len(key)
                lead[:run_end] = leader
            last_key, last_a, leader = key[-1], a[-1], lead[-1]
            shared = a != lead
            if shared.any():
                yield pa.RecordBatch.from_pydict({"signature": key[shared], "a": a[shared], "leader": lead[shared]})

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return as_arrow(index.repartition(parts, "signature").sortWithinPartitions("signature", "a"), run, "signature long, a long, leader long")


def trimmed(index: DataFrame, described: DataFrame, chosen: dict[int, tuple[int, int]]) -> DataFrame:
    """a, leader: each set with the leaders of its shared signatures, after those given up for their cost."""
    counts = index.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.min("leader").alias("leader"))
    entries = index.select("signature", "a").union(counts.select("signature", F.col("leader").alias("a")))
    tags = index.sparkSession.createDataFrame([(b * 8 + p, b * 2 + i) for b, both in chosen.items() for i, p in enumerate(both)], "plan int, tag int")  # two a band
    of = described.select("a", F.explode("slacks").alias("x")).join(F.broadcast(tags), F.col("x.plan") == F.col("plan"))
    slack = of.groupBy("a", "tag").agg(F.min("x.slack").alias("slack"))
    known = entries.join(counts.select("signature", "n"), "signature").withColumn("tag", F.col("signature").bitwiseAND(511).cast("int"))
    rank = F.row_number().over(Window.partitionBy("a", "tag").orderBy(F.desc("n"), "signature"))
    kept = saved(known.withColumn("rank", rank).join(slack, ["a", "tag"]).where("rank > slack").select("signature", "a"), "kept")
    central = kept.join(entries.groupBy("a").agg(F.count(F.lit(1)).alias("shared")), "a")
    leaders = central.groupBy("signature").agg(F.max(F.struct("shared", "a")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    led_by = kept.join(leaders.select("signature", F.col("hub.a").alias("leader")), "signature")
    votes = saved(led_by.where("a <> leader").select("a", "leader").distinct(), "votes")
    freed(kept)
    return votes


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of 2^bits top parts the column's values have, as packed bits: 2^bits / 8 bytes in all, in bitmaps of 4 KB."""
    top = F.shiftrightunsigned(F.col(column), 64 - bits)
    maps = df.groupBy(F.shiftright(top, 15).alias("chunk")).agg(F.bitmap_construct_agg(top.bitwiseAND(32767)).alias("bits"))
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for r in maps.collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def has_bit(packed: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    at = (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def changed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of x alone, values of y alone), of sorted sets."""
    both = np.concatenate([x, y])
    order = np.argsort(both, kind="stable")
    both = both[order]
    alone = np.ones(len(both), bool)
    same = both[1:] == both[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    mine = order < len(x)
    return both[alone & mine], both[alone & ~mine]


COMPARED = "x long, y long, n long, n_y long, d long, near boolean, gained binary, lost binary"


def compared(df: DataFrame, votes: DataFrame, k: int, percent: int, passes: int = 1) -> DataFrame:
    """Each set x with each leader y: their sizes n and n_y, in how many shingles d they differ, whether they link, and, for
    leaders of several sets, which shingles x has gained and lost."""
    spark = df.sparkSession
    members, leading = (spark.sparkContext.broadcast(bit_filter(votes, c, FILTER_BITS)) for c in ("a", "leader"))  # 2 MB each

    def pick(batches):
        recent = Recent()
        for batch in pieces(batches):
            shingles, first = sets(batch.column("text"), k)
            a = digests(shingles, first)
            some = recent.fresh(a)
            member, leads = (has_bit(x.value, a[some], FILTER_BITS) for x in (members, leading))
            kept = (np.diff(first)[some] > 0) & (member | leads)
            some, member, leads = some[kept], member[kept], leads[kept]
            if len(some):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[some]), "member": pa.array(member), "leads": pa.array(leads), "held": pa.array([shingles[first[i] : first[i + 1]].tobytes() for i in some.tolist()], pa.binary())})

    held = as_arrow(df.select("text"), pick, "a long, member boolean, leads boolean, held binary")
    held = saved(held.groupBy("a", "member", "leads").agg(F.min("held").alias("held")), "held")

    def test(batches):
        for batch in pieces(batches, "held_y"):
            rows = []
            for x, y, several in zip(batch.column("held_x"), batch.column("held_y"), batch.column("several").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                gained, lost = changed(x, y)
                d = len(gained) + len(lost)
                rows.append((len(x), len(y), d, d * (100 + percent) <= (100 - percent) * (len(x) + len(y)), gained.tobytes() if several else None, lost.tobytes() if several else None))
            n, n_y, d, near, gained, lost = zip(*rows, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(n_y, pa.int64()), pa.array(d, pa.int64()), pa.array(near), pa.array(gained, pa.binary()), pa.array(lost, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *made], ["x", "y", "n", "n_y", "d", "near", "gained", "lost"])

    leaders = votes.groupBy("leader").agg((F.count(F.lit(1)) > 1).alias("several"))
    pairs = votes.join(leaders, "leader").select(F.col("a").alias("x"), F.col("leader").alias("y"), "several")
    held_x, held_y = (held.where(role).select(F.col("a").alias(c), F.col("held").alias(f"held_{c}")) for c, role in (("x", "member"), ("y", "leads")))

    def tested(turn: int) -> DataFrame:
        now = F.lit(True) if passes == 1 else F.pmod(F.xxhash64("x"), F.lit(passes)) == turn
        joined = pairs.where(now).join(held_x.where(now), "x").join(held_y, "y")
        return as_arrow(joined.select("x", "y", "several", "held_x", "held_y"), test, COMPARED)

    out = in_turns(tested, passes, "compared")
    freed(held)
    return out


def between(tested: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """x, y: labels of components that a link between two sets of one leader joins. `tested`, a saved table, goes once its part is copied."""
    spark = tested.sparkSession
    up, down = 100 - percent, 100 + percent  # sets link if d * down <= up * (n + n_y)
    own = small(labels).select(F.col("a").alias("x"), "label")
    members = tested.where(F.col("gained").isNotNull()).join(own, "x", "left").withColumn("label", F.coalesce("label", "x"))
    groups = members.groupBy("y").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    groups = saved(groups.select("y"), "mixed")
    members = saved(members.join(small(groups), "y", "left_semi"), "members")
    freed(groups, tested)

    def repeated(batches):  # a leader's sets come together, so that its common shingles meet in a batch
        for batch in pieces(batches, "lost"):
            rows = zip(batch.column("y").to_pylist(), batch.column("gained"), batch.column("lost"), strict=True)
            keys = [under(y, np.frombuffer(gained.as_py() + lost.as_py(), np.uint64)) for y, gained, lost in rows]
            keys, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(keys[n > 1].view(np.int64)), "n": pa.array(n[n > 1])})

    often = as_arrow(members.select("y", "gained", "lost"), repeated, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    frequent = spark.sparkContext.broadcast(bit_filter(often, "pair", OFTEN_BITS))  # 8 MB

    def first_ones(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> pa.RecordBatch:
        """The shingles by which each member may meet a partner, those alone whose pair the filter `wanted` has."""
        numbers = [batch.column(c).to_pylist() for c in ("y", "n", "n_y", "d", "near")]
        keys, rows, at, far = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for y, n, n_y, d, near, gained, lost in zip(*numbers, batch.column("gained"), batch.column("lost"), strict=True):
            # A partner differs from the leader by so much that both differ by little, so they share `common` or more; one that
            # isn't linked with the leader shares at least `common_far`, and one that is differs from it by no more than `most`.
            common = max(1, -(-(down * d - up * (n + n_y)) // 200))
            common_far = max(common, (down * d + up * (n_y - n)) // (2 * down) + 1)
            most = 2 * up * n_y // (down - up)
            among_far = max(0, d + 1 - common_far)
            take = among_far if near or common > most else d + 1 - common
            key = under(y, np.frombuffer(gained.as_py() + lost.as_py(), np.uint64))
            order = np.lexsort((key, np.arange(d) >= len(gained.as_py()) // 8, has_bit(frequent.value, key, OFTEN_BITS)))[: max(take, 0)]
            place = np.arange(1, len(order) + 1)
            if wanted is not None:
                place = place[has_bit(wanted, key[order], OFTEN_BITS)]
            keys.append(key[order[place - 1]])
            rows.append(len(place))
            at.append(place)
            far.append(place <= among_far)
        rows = pa.array(np.repeat(np.arange(batch.num_rows), rows))
        made = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(at)), pa.array(np.concatenate(far))]
        return pa.RecordBatch.from_arrays([*made, *(batch.column(c).take(rows) for c in ("x", "y", "n", "d", "near", "label"))], ["pair", "at", "far", "x", "y", "n", "d", "near", "label"])

    met = as_arrow(members, lambda batches: (first_ones(b).select(["pair", "label"]) for b in pieces(batches, "lost")), "pair long, label long")
    met = met.groupBy("pair").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    wanted = spark.sparkContext.broadcast(bit_filter(met, "pair", OFTEN_BITS))  # 8 MB
    schema = "pair long, at long, far boolean, x long, y long, n long, d long, near boolean, label long"
    found = saved(as_arrow(members, lambda batches: (first_ones(b, wanted.value) for b in pieces(batches, "lost")), schema), "first-ones")
    f, g = found.where("not near").alias("f"), found.alias("g")
    enough = F.lit(2 * down) * (1 + F.least(F.expr("f.d - f.at"), F.expr("g.d - g.at"))) >= F.lit(down) * F.expr("f.d + g.d") - F.lit(up) * F.expr("f.n + g.n")
    which = (F.col("f.pair") == F.col("g.pair")) & (F.col("f.y") == F.col("g.y")) & (F.col("f.label") != F.col("g.label")) & (F.col("g.near") | (F.col("f.far") & F.col("g.far") & (F.col("f.x") < F.col("g.x"))))
    pairs = f.join(g, which & enough).groupBy(F.least("f.x", "g.x").alias("x"), F.greatest("f.x", "g.x").alias("z")).agg(F.min("f.y").alias("y"))
    pairs = saved(pairs, "pairs")
    end = F.xxhash64("x", "y").alias("end")
    ends = spark.sparkContext.broadcast(bit_filter(pairs.select("y", F.explode(F.array("x", "z")).alias("x")).select(end), "end", OFTEN_BITS))  # 8 MB

    def meeting(batches):
        for batch in batches:
            yield batch.filter(pa.array(has_bit(ends.value, batch.column("end").to_numpy(), OFTEN_BITS)))

    whole = as_arrow(members.select("x", "y", "n", "label", F.concat("gained", "lost").alias("held"), end), meeting, "x long, y long, n long, label long, held binary, end long")
    whole = saved(whole.drop("end"), "meeting")
    freed(members, found)
    sides = [whole.select("y", F.col("x").alias(c), F.col("n").alias(f"n_{c}"), F.col("label").alias(f"label_{c}"), F.col("held").alias(f"held_{c}")) for c in ("x", "z")]

    def test(batches):
        for batch in pieces(batches, "held_z"):
            keep = []
            for n_x, n_z, x, z in zip(batch.column("n_x").to_pylist(), batch.column("n_z").to_pylist(), batch.column("held_x"), batch.column("held_z"), strict=True):
                both = np.sort(np.frombuffer(x.as_py() + z.as_py(), np.uint64))
                d = len(both) - 2 * int((both[1:] == both[:-1]).sum())
                keep.append(d * down <= up * (n_x + n_z))
            if any(keep):
                yield pa.RecordBatch.from_arrays([batch.column("label_x"), batch.column("label_z")], ["x", "y"]).filter(pa.array(keep))

    joined = pairs.join(sides[0], ["x", "y"]).join(sides[1], ["z", "y"]).select("n_x", "n_z", "label_x", "label_z", "held_x", "held_z")
    out = saved(as_arrow(joined, test, "x long, y long").distinct(), "between")
    freed(whole, pairs)
    return out


def under(leader: int, shingles: np.ndarray) -> np.ndarray:
    """Hashes of shingles together with a leader."""
    return mix(shingles + mix(np.array([leader], np.int64).view(np.uint64)))


def components(links: DataFrame) -> DataFrame:
    """a, label: each linked set with the least set of its component. Each round takes the least label among neighbours and
    then that label's own label; rounds end when no label changes."""
    both = saved(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "both")
    labels = saved(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "a"), "labels")
    while True:
        sent = small(labels)
        near = both.join(sent.select(F.col("a").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = near.join(sent.select(F.col("a").alias("x"), "label"), "x").select(F.col("x").alias("a"), F.least("label", "near").alias("next"), "label")
        jump = sent.select(F.col("a").alias("next"), F.col("label").alias("far"))
        new = saved(step.join(jump, "next", "left").select("a", F.least("next", F.coalesce("far", "next")).alias("label"), (F.col("next") != F.col("label")).alias("changed")), "labels")
        freed(labels)
        labels = new.drop("changed")
        if not new.where("changed").take(1):
            freed(both)
            return labels


def link_sets(df: DataFrame, k: int, percent: int, passes: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sets of all documents, a and label of the sets in components of several)."""
    described, chosen = describe(df.select("doc_id", "text"), k, percent)
    index = in_turns(lambda turn: led(entries(df, k, percent, chosen, passes, turn)), passes, "index")
    votes = trimmed(index, described, chosen)
    freed(index)
    tested = compared(df, votes, k, percent, passes)
    freed(votes)
    labels = components(tested.where("near").select("x", "y"))
    more = between(tested, labels, percent)
    if more.take(1):
        joined = small(components(more)).select(F.col("a").alias("label"), F.col("label").alias("top"))
        single = joined.select(F.col("label").alias("a"), F.col("top").alias("label"))  # roots aren't named in labels
        named = labels.join(joined, "label", "left").select("a", F.coalesce("top", "label").alias("label"))
        labels = saved(named.union(single).distinct(), "labels")
    freed(more)
    return described, labels


#: At most so many sets that many documents have are sent to all executors.
HEAVY = 10_000


def named(described: DataFrame, labels: DataFrame) -> DataFrame:
    """(described with the label of each row's component, label and least doc_id of each component). Copies are counted before
    anything is dealt by set; sets that make up more than 1 / HEAVY of all rows are joined without dealing their rows to one task."""
    by_set = described.where("n_shingles > 0").groupBy("a").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    by_set = by_set.join(small(labels), "a", "left").withColumn("label", F.coalesce("label", "a"))
    by_set = saved(by_set.withColumn("total", F.lit(described.count())), "by-set")
    least = by_set.groupBy("label").agg(F.min("least").alias("least"))
    classes = saved(by_set.join(least.withColumnRenamed("least", "first"), "label").select("a", "label", F.col("first").alias("least"), (F.col("copies") * HEAVY > F.col("total")).alias("heavy")), "classes")
    freed(by_set)
    heavy = classes.where("heavy").drop("heavy")
    light = classes.where("not heavy").drop("heavy")
    worded = described.where("n_shingles > 0")
    few = worded.join(F.broadcast(heavy.select("a")), "a", "left_anti").join(light, "a")
    none = described.where("n_shingles = 0").withColumns({"label": F.lit(0).cast("long"), "least": F.lit(None).cast("long")})
    return worded.join(F.broadcast(heavy), "a").unionByName(few).unionByName(none)


def join(df: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links of at least `percent` reach."""
    rows = named(*link_sets(df, k, percent))
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", passes: int = 1) -> DataFrame:
    """The rows of df without near duplicates: of each component the row of the least doc_id stays (a null counts as greatest,
    of equal rows one stays); rows without words all stay."""
    docs = df.select("doc_id", F.col(text).alias("text"))
    described, labels = link_sets(docs, k, percent, passes)
    rows = named(described, labels)
    if keyed(described, "doc_id"):
        gone = saved(rows.where("n_shingles > 0 and doc_id <> least").select("doc_id"), "gone")
        return df.join(small(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    worded = rows.where("n_shingles > 0").groupBy("label")
    kept = worded.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a")).alias("best")).select("best.doc_id", "best.a")
    key, number = (next(c for c in (f"{stem}{i}" for i in range(len(df.columns) + 1)) if c not in df.columns) for stem in ("set_", "row_"))

    def run(batches):
        for batch in pieces(batches, text):
            shingles, first = sets(batch.column(text), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.diff(first) > 0, digests(shingles, first), 0))], [*batch.schema.names, key])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    known = as_arrow(df, run, f"{schema}, {key} long")
    found = known.where(F.col(key) != 0).join(kept, known["doc_id"].eqNullSafe(kept["doc_id"]) & (known[key] == kept["a"]), "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(1)))  # equal rows only
    columns = [F.col(f"`{c}`") for c in df.columns]
    return found.withColumn(number, one).where(F.col(number) == 1).select(*columns).union(known.where(F.col(key) == 0).select(*columns))
