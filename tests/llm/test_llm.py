"""The operators against plain versions on small tables with every awkward case."""

import base64
import collections
import hashlib
import os
import random
import re
import urllib.parse
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from urbangraph.llm import bpe, jaccard, jpeg, media, mixing, pii, quality, sstable, suffix, token_counts, toxicity
from urbangraph.llm.arrays import utf8

TIK, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def of(row):
    return row[1] or ""


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def awkward(docs):
    """Further columns with the names that operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("size", "score", "a", "k", "target", "n_bytes", "ids", "spans", "text_id", "kept", "label")})


# media


def test_jpeg_round_trip_and_slow_path(monkeypatch):
    rng = np.random.default_rng(0)
    files = [(p, jpeg.encode(p)) for n in (1, 2, 7, 2100) for p in [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes()]]
    for payload, file in files:
        assert jpeg.Image(file).payload() == payload
    shown = jpeg.Image(files[2][1]).rgb()
    monkeypatch.setattr(jpeg.Image, "scan_at_once", lambda *a: False)
    for payload, file in files[:3]:
        assert jpeg.Image(file).payload() == payload
    assert (jpeg.Image(files[2][1]).rgb() == shown).all()


def test_jpeg_transform():
    flat = np.zeros((1, 64), np.float32)
    flat[0, 0] = 80
    assert np.allclose(flat @ jpeg.INVERSE, 10)
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_media(docs, rows, nothing):
    out = media.digests(media.load(media.store(awkward(docs)), tensor=False)).collect()
    assert len(out) == len(rows)
    want = collections.Counter()
    for r in rows:
        t = of(r).encode()
        p = t + b" " * (max(192, -(-len(t) // 192) * 192) - len(t))
        want[r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    by = collections.defaultdict(set)
    for r in out:
        by[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    tensor = media.load(media.store(docs.where("doc_id = 5"))).first()
    assert len(tensor.tensor) == tensor.height * tensor.width * 3
    assert media.digests(media.load(media.store(nothing), tensor=False)).count() == 0


def test_media_tensors_are_stored(docs, rows, nothing, tmp_path):
    loaded = media.load(media.store(awkward(docs)))
    folder = f"file://{tmp_path}/tensors"
    out = media.stored_digests(loaded, folder)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, media.digests(loaded).collect()), key=str)
    assert out.count() == len(rows)
    assert docs.sparkSession.read.parquet(folder).where("tensor is null").count() == 0
    assert media.stored_digests(media.load(media.store(nothing))).count() == 0


def test_jpeg_samples_against_the_plain_transform():
    """Whole-number samples and colours are within 2 of those by real numbers."""
    rng = np.random.default_rng(3)
    for n in (1, 5):
        image = jpeg.Image(jpeg.encode(rng.integers(0, 40, 384 * n, dtype=np.uint8).tobytes()))
        planes = []
        for c in image.components.values():
            plane = np.zeros((8 * c.rows, 8 * c.stride))
            for i, block in enumerate(c.coefficients.reshape(-1, 64)):
                square = np.zeros((8, 8))
                square.ravel()[jpeg.ZIGZAG] = block
                y, x = divmod(i, c.stride)
                for v in range(8):
                    for h in range(8):
                        plane[8 * y + v, 8 * x + h] = sum(square[a, b] * (0.5**0.5 if a == 0 else 1) * (0.5**0.5 if b == 0 else 1) / 4 * np.cos((2 * v + 1) * a * np.pi / 16) * np.cos((2 * h + 1) * b * np.pi / 16) for a in range(8) for b in range(8))
            planes.append(np.repeat(np.repeat(plane, image.most_v // c.v, 0), image.most_h // c.h, 1)[: image.height, : image.width])
        y, cb, cr = planes[0] + 128, *planes[1:]
        want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)
        assert np.abs(image.rgb() - want).max() <= 2


# byte-level BPE


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIK, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, nothing, tik):
    out = bpe.digests(bpe.decode(bpe.encode(awkward(docs), TIK), TIK))
    want = collections.Counter()
    for r in rows:
        ids = tik.encode_ordinary(of(r))
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(of(r).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, out.collect())) == want
    assert collections.Counter(map(tuple, bpe.digests(bpe.round_trip(awkward(docs), TIK)).collect())) == want
    assert bpe.decode(bpe.encode(nothing, TIK), TIK).count() == bpe.round_trip(nothing, TIK).count() == 0


def test_transducer_forgets():
    ranks = bpe.ranks(TIK)
    machine, words, rng = bpe.Transducer(ranks, most=2000), list(ranks), random.Random(5)
    for i in range(3000):
        kinds = (rng.randbytes(rng.randrange(12)), b"".join(rng.choices(words, k=3)), "".join(rng.choices("abinrst é日🎉", k=9)).encode(), b"a" * (i % 70))
        word = kinds[i % 4]
        assert machine.encode(word) == [ranks[part] for part in machine.merged(word)]
        assert len(machine.steps) <= 2000 and len(machine.states) <= 2001


def test_utf8_stream():
    stream = bpe.Utf8Stream({bytes([i]): i for i in range(256)})
    for data in ("é日😀".encode(), b"\xe0\x80\x80a", b"\xf0\x9f\x98", b"\xff\xc3(\xed\xa0\x80", bytes(range(128, 256))):
        assert stream.decode(list(data)) == data.decode("utf8", "replace").encode()


# token counts and shards


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(JSON)


def test_token_counts(spark, docs, rows, nothing, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    out = token_counts.token_counts(awkward(docs), JSON, cache)
    want = collections.Counter((r[0], len(of(r).encode()), len(library.encode(of(r), add_special_tokens=False).ids)) for r in rows)
    assert collections.Counter(map(tuple, out.collect())) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({of(r) for r in rows})
    assert collections.Counter(map(tuple, token_counts.token_counts(docs, JSON, cache).collect())) == want
    assert spark.read.parquet(cache).count() == stored  # nothing was encoded again
    assert token_counts.token_counts(nothing, JSON, cache).count() == 0


def test_sstable(docs, rows, nothing, library):
    files = sstable.write(awkward(docs), JSON, shards=3)
    out = sstable.digests(sstable.read(files)).orderBy("start").collect()
    ids = [(r[0], [*library.encode(of(r), add_special_tokens=False).ids, 2]) for r in rows]
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in out]
    assert keys == sorted(keys)
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])[:-1]]).tolist()
    shards = [r.file for r in files.orderBy("shard").collect()]
    for i in (0, 33, 69, 73, None, 10_000):
        assert sorted(x.tolist() for x in sstable.lookup(shards, i)) == sorted(x for k, x in ids if k == i), i
    assert sstable.read(sstable.write(nothing, JSON)).count() == 0


def test_sstable_keys(spark, library):
    ids = [None, None, -(1 << 63), -(1 << 63), -1, 0, (1 << 63) - 1]
    assert [sstable.id_of(sstable.key_of(i)) for i in ids] == ids
    assert [sstable.key_of(i, k) for k, i in enumerate(ids)] == sorted(sstable.key_of(i, k) for k, i in enumerate(ids))
    files = sstable.write(spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string"), JSON, shards=4)
    assert sorted(map(str, [r.doc_id for r in sstable.digests(sstable.read(files)).collect()])) == sorted(map(str, ids))
    shards = [r.file for r in files.orderBy("shard").collect()]
    want = lambda i: sorted([*library.encode(f"text {k}", add_special_tokens=False).ids, 2] for k, j in enumerate(ids) if j == i)
    for i in (*ids, 7, -(1 << 63) + 1):
        assert sorted(x.tolist() for x in sstable.lookup(shards, i)) == want(i), i


# quality


def plain_counts(t):
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.weights(awkward(docs), labels)
    out = quality.score(awkward(docs), model).collect()
    want = collections.Counter((r[0], *plain_counts(of(r))) for r in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in out)
    assert len({quality.score(docs, model).where("doc_id = 5").first().score for _ in range(2)}) == 1
    assert quality.weights(docs, labels.limit(0)) == [0] * quality.BUCKETS
    assert quality.quality(nothing, labels).count() == 0


# mixing


def test_mixing(docs, rows, nothing):
    out = mixing.mix(awkward(docs)).collect()
    size = lambda r: len(WORD.findall(of(r)))
    assert collections.Counter((r.doc_id, r.size) for r in out) == collections.Counter((r[0], size(r)) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, [5, 2, 1] * 9, strict=False))
    target, left, open_ = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in sizes)
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    assert {round(r.target, 6) for r in out} == {round(t, 6) for t in target.values()}
    assert all(r.taken <= 2 * r.size for r in out)
    assert sorted_rows(mixing.mix(docs)) == sorted(map(tuple, out), key=lambda r: tuple((x is None, str(x)) for x in r))
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies_taken for r in out)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# toxicity


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    word = lambda: str(rng.choice(vocabulary))
    rows = []
    for i in range(400):
        words = [word() for _ in range(int(rng.integers(5, 160)))]
        if i % 4 == 0:
            words[int(rng.integers(len(words)))] = "vile" + word()[:2]
        rows.append((i, " ".join(words)))
    rows += [(400, None), (401, ""), (None, "vileab"), (402, rows[0][1]), (402, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    assert {r.score for r in out if r.doc_id in (400, 401)} == {0.0}
    assert len({r.score for r in out if r.doc_id in (0, 402)}) == 1
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_toxicity_windows_cover_all_words():
    t = toxicity.Texts(*utf8(pa.array([" ".join(map(str, range(500))), "", "a b", None])))
    assert np.diff(t.first).tolist() == [1 + -(-(500 - 48) // 32), 0, 1, 0]
    covered = {int(a) + i for a, n in zip(t.at, t.size, strict=True) for i in range(int(n))}
    assert covered == set(range(502))


# n-gram Jaccard join


def plain_components(texts, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, rows, k, percent):
    sets, roots = plain_components([r[1] for r in rows], k, percent)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min((x for x in (least.get(root), r[0]) if x is not None), default=None)
    want = collections.Counter((r[0], len(s), least[root] if s else r[0]) for r, s, root in zip(rows, sets, roots, strict=True))
    assert collections.Counter(map(tuple, jaccard.join(awkward(docs), k, percent).collect())) == want
    kept = jaccard.distinct(docs, k, percent)
    assert kept.columns == docs.columns
    assert kept.count() == len({root for s, root in zip(sets, roots, strict=True) if s}) + sum(not s for s in sets)


def edited(rng, base, share, vocabulary):
    """base with a share of its words left out, replaced or followed by another one."""
    out = []
    for w in base:
        kind = rng.randrange(3) if rng.random() < share else 3
        out += {0: [], 1: [rng.choice(vocabulary)], 2: [w, rng.choice(vocabulary)], 3: [w]}[kind]
    return " ".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_finds_all_links_of_a_group_around_the_threshold(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40 if seed == 2 else 4000)]
    texts = []
    for size in (60, 150, 400):
        base = [rng.choice(vocabulary) for _ in range(size)]
        side = edited(rng, base, 0.05, vocabulary).split()
        texts += [edited(rng, rng.choice((base, base, side)), rng.uniform(0.005, 0.08), vocabulary) for _ in range(140)]
    rng.shuffle(texts)
    sets, roots = plain_components(texts, 4, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert found == {i: (len(s), root) for i, (s, root) in enumerate(zip(sets, roots, strict=True))}
    sets, roots = plain_components(texts, 5, 80)
    assert sorted(r.doc_id for r in jaccard.distinct(df).collect()) == sorted(set(roots))


def test_jaccard_plans():
    rng = np.random.default_rng(3)
    n = np.repeat([3, 9, 14, 40, 90, 260, 700], 30)
    first = np.concatenate([[0], np.cumsum(n)])
    shingles = rng.integers(0, 1 << 63, first[-1], dtype=np.int64).astype(np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    shingles = shingles[np.lexsort((shingles, doc))]
    for percent, kind in ((85, "plain"), (80, "near"), (85, "single")):
        chosen = {b: (next((i for i, x in enumerate(jaccard.plans(b, percent)) if x[0] == kind), len(jaccard.plans(b, percent)) - 1), len(jaccard.plans(b, percent)) - 1) for b in range(60)}
        keys, owner = jaccard.signatures(shingles, first, percent, chosen)
        of = {i: set(keys[owner == i].tolist()) for i in range(len(n))}
        for i in range(len(n)):  # a partner at the threshold shares a signature
            mine = shingles[first[i] : first[i + 1]]
            lost = rng.permutation(len(mine))[: len(mine) * (100 - percent) // 100]
            partner = np.delete(mine, lost)
            if len(partner):
                other, _ = jaccard.signatures(partner, np.array([0, len(partner)]), percent, chosen)
                if kind != "near" or n[i] >= 90:  # near plans need room for empty segments
                    assert of[i] & set(other.tolist())


def test_jaccard_in_turns(docs):
    _, chosen = jaccard.describe(docs.select("doc_id", "text"), 5, 80)
    whole, *turns = ([tuple(r) for r in jaccard.entries(docs, 5, 80, chosen, *turn).collect()] for turn in ((), (2, 0), (2, 1)))
    assert sorted(turns[0] + turns[1]) == sorted(whole) and not {s for s, _ in turns[0]} & {s for s, _ in turns[1]}
    assert max(map(len, turns)) < 0.6 * len(whole)  # what is on disk at once
    assert sorted_rows(jaccard.distinct(docs, passes=3)) == sorted_rows(jaccard.distinct(docs))


def test_jaccard_keeps_what_is_still_needed(docs, monkeypatch):
    made, saved, left = {}, jaccard.saved, []

    def seen(df, name):
        if name in ("first-ones", "between"):  # what is on disk at the steps that deal out most
            left.append({k for k, tables in made.items() for t in tables if any(os.path.exists(urllib.parse.urlparse(f).path) for f in t.inputFiles())})
        out = saved(df, name)
        made.setdefault(name, []).append(out)
        if name == "held":
            roles.extend(out.select("member", "leads").collect())
        return out

    roles = []
    monkeypatch.setattr(jaccard, "saved", seen)
    jaccard.distinct(docs, passes=2)
    assert all(r.member or r.leads for r in roles) and not all(r.leads for r in roles)  # leaders alone are dealt as such
    assert "members" in left[0] and not {"compared", "votes", "mixed"} & left[0]
    assert "meeting" in left[1] and not {"members", "first-ones"} & left[1]


def test_jaccard_on_empty_table(nothing):
    assert jaccard.join(nothing).count() == 0 and jaccard.distinct(nothing).count() == 0


# passages


def plain_removal(rows):
    first = {}
    for i, t in sorted(((LAST if r[0] is None else r[0], of(r).encode()) for r in rows)):
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], LAST))
    out = collections.Counter()
    for r in rows:
        t, i = of(r).encode(), LAST if r[0] is None else r[0]
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[r[0], len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()] += 1
    return out


LAST = suffix.LAST


def test_suffix(docs, rows, nothing):
    out = suffix.dedup(awkward(docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert collections.Counter(tuple(r)[:5] for r in out) == plain_removal(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)
    assert suffix.dedup(nothing).count() == 0


def test_passages_of_few_letters(spark):
    """Repeats at all places of an anchor, periodic texts, and chance meetings of anchors."""
    rng = random.Random(5)
    part = ["".join(rng.choice("ab") for _ in range(rng.choice((24, 36, 37, 49, 50, 51, 90)))) for _ in range(30)]
    made = [(i, rng.choice(("", "a" * 60, "ab" * 70, "xyz")).join(rng.choice(part) for _ in range(rng.randint(0, 9))), "", "", 0) for i in range(150)]
    out = suffix.dedup(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n long").repartition(4), keep_text=False)
    assert collections.Counter(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == plain_removal(made)


def test_suffix_arrays_end_at_the_length_of_a_string(monkeypatch):
    """Nearly equal fragments are not told apart beyond the bytes that decide."""
    rng = np.random.default_rng(4)
    same = rng.integers(0, 4, 112, np.uint8).tobytes()
    bodies = [*(same + bytes([k]) for k in range(8)), same[:70], same[20:75] + b"x"]
    docs, sorts, argsort = np.arange(10)[::-1], [], np.argsort
    monkeypatch.setattr(suffix.np, "argsort", lambda *a, **b: sorts.append(len(a[0])) or argsort(*a, **b))
    least = suffix.least_documents(bodies, docs)
    assert len(sorts) <= 4  # by 7 bytes, 14, 28 and 56
    first = {}
    for d, b in sorted(zip(docs.tolist(), bodies, strict=True)):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], d)
    assert [x.tolist() for x in least] == [[first[b[p : p + 50]] for p in range(len(b) - 49)] for b in bodies]


def test_suffix_shards_agree(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 400)  # an anchor goes on over several shards
    bodies = [(b"0123456789" * 12)[k : k + 60 + k] for k in range(8)] * 3
    doc = np.sort(np.arange(24) % 7)
    anchor = np.full(24, 5)
    whole = suffix.shard(anchor, doc, bodies, suffix.Carried(), False)
    carried, parts = suffix.Carried(), []
    for i in range(0, 24, 5):
        parts += suffix.shard(anchor[i : i + 5], doc[i : i + 5], bodies[i : i + 5], carried, i + 5 < 24)
    assert all((a is None) == (b is None) and (a is None or (a == b).all()) for a, b in zip(whole, parts, strict=True))


def test_suffix_splits_anchors_of_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "MOST", 5)
    rng = random.Random(3)
    around = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(60))
    phrase = around()[:45]
    rows = [(k, around() + phrase + around(), "en", "s", 0) for k in range(60)]
    rows += [(60 + k, around() + rows[k][1][20:150] + around(), "en", "s", 0) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    met, repeats = [], suffix.repeats
    monkeypatch.setattr(suffix, "repeats", lambda sent: met.extend(sent.where("body is not null").groupBy("anchor").agg(F.countDistinct("body").alias("n")).collect()) or repeats(sent))
    out = suffix.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert collections.Counter(map(tuple, out)) == plain_removal(rows)
    assert sum(r.n_removed > 0 for r in out) >= 20
    assert met and max(r.n for r in met) <= 5


# personal data


def plain_spans(x):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(y) <= 255 for y in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_pii(docs, rows, nothing):
    out = pii.spans(awkward(docs)).collect()
    want = collections.Counter()
    for r in rows:
        s = plain_spans(of(r))
        want[r[0], *(sum(k == i for *_, k in s) for i in range(4)), hashlib.sha256(pii.joined(s).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:6] for r in out) == want
    assert all(set(filter(None, pii.joined(plain_spans(t)).split(","))) <= set(r.spans.split(",")) for r in out for t in [next((of(x) for x in rows if x[0] == r.doc_id), "")] if r.doc_id is not None)
    red = pii.redact(docs)
    assert red.columns == docs.columns and "[EMAIL]" in red.where("doc_id = 74").first().text
    assert pii.spans(nothing).count() == 0


def test_field_on_held_out_examples():
    field, right = pii.train(), 0
    made = pii.examples(123)
    for text, spans in made:
        base = pii.base_spans(text)
        right += set(base + pii.added_spans(field, text, base)) == set(spans)
    assert right / len(made) > 0.9


def test_long_digit_runs():
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(0, 5007, 1)]
    assert pii.base_spans("a" * 200_000 + "@") == []
