"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from urbangraph.llm import chat, clustering, queries, resampling

MESSAGES = "id string, parent string, role string, text string, score double, thread long"


# chat


def test_template_is_reversible():
    template, rng = chat.Template(), random.Random(3)
    bits = ["<", "s", ">", "/", "\\", "[", "INST]", "/INST]", "</s>", "<s>", "[INST] ", "é😀", "\n", "a ", ""]
    text = lambda: "".join(rng.choices(bits, k=rng.randrange(9)))
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "", text()]), text()) for _ in range(rng.randrange(1, 5))]
        out, mask = template.format(turns)
        assert template.parse(out) == turns
        assert template.learned(out, mask) == "".join(t for r, t in turns if r == "assistant")
        for piece in (template.escape(t) for _, t in turns):
            assert not any(c in piece for c in template.controls) and template.unescape(piece) in [t for _, t in turns]
    with pytest.raises(ValueError, match="overlap"):
        chat.Template(controls=("<s>", "</s>", "[INST]", "aba"))
    with pytest.raises(ValueError, match="among"):
        chat.Template(begin="<t>")


def plain_paths(rows, best):
    """{leaf: (root, depth, score, rank, [(role, text)])} by walking up from each leaf."""
    least = {}
    for i, parent, role, text, score, _ in rows:
        if i is not None:
            key = (parent is not None, parent or "", score or 0.0, role or "", text or "")
            least[i] = min(least.get(i, key), key)
    parent = {i: k[1] if k[0] and k[1] in least else None for i, k in least.items()}
    found = collections.defaultdict(list)
    for leaf in set(least) - set(parent.values()):
        path = [leaf]
        while parent[path[-1]] is not None and len(path) <= len(least):
            path.append(parent[path[-1]])
        if len(path) <= len(least):
            score = sum(least[i][2] for i in path) / len(path)
            found[path[-1]].append((-score, leaf, path[::-1]))
    return {leaf: (root, len(path) - 1, pytest.approx(-score), k + 1, [least[i][3:] for i in path]) for root, every in found.items() for k, (score, leaf, path) in enumerate(sorted(every)[:best])}


def message_rows():
    rng = random.Random(7)
    rows = [(f"m{i}", f"m{rng.randrange(max(0, i - 9), i)}" if i and rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["</s>", "hi\n", "", None, "x" * 70]), rng.choice([None, 0.5, 1.0, 3.0]), i) for i in range(80)]
    rows += [(f"c{i}", f"c{i - 1}" if i else None, "user", f"turn {i}", 1.0, 0) for i in range(37)]  # a long chain
    rows += [(f"s{i}", "hub", "assistant", f"{i}", float(i % 3), 0) for i in range(60)] + [("hub", "gone", "user", "many reply", 0.0, 5)]
    rows += [("o1", "o2", "user", "a", 1.0, 0), ("o2", "o3", "user", "b", 1.0, 0), ("o3", "o1", "user", "c", 1.0, 0), ("o4", "o1", "user", "hangs on a circle", 1.0, 0), ("o5", "o5", "user", "to itself", 1.0, 0)]
    return rows + [rows[3], ("m5", "m4", "user", "another row of that id", 2.0, 0)]


@pytest.mark.parametrize(("best", "many"), [(1, 10_000), (3, 10), (1000, 10)])
def test_reply_trees(spark, monkeypatch, best, many):
    monkeypatch.setattr(chat, "MANY", many)
    rows = message_rows()
    messages = spark.createDataFrame(rows, MESSAGES).repartition(3)
    clash = messages.selectExpr("*", "1 as leaf", "2 as key", "3 as top", "4 as kept")
    template = chat.Template()
    out = chat.conversations(clash, best, keep=("thread",)).collect()
    want = plain_paths(rows, best)
    assert {r.leaf: (r.root, r.depth, r.score, r["rank"], template.parse(r.text)) for r in out} == want
    assert len(out) == len(want) and next(r.thread for r in out if r.root == "hub") == 5


def test_messages_without_ids_and_empty_tables(spark):
    rows = [(None, "a", "user", "x", 1.0, 1), (None, "a", "user", "x", 1.0, 1), (None, None, None, None, None, None), ("a", None, "user", "root", 0.0, 1)]
    out = chat.conversations(spark.createDataFrame(rows, MESSAGES), 5).collect()
    turns = sorted([t for _, t in chat.Template().parse(r.text)] for r in out)
    assert turns == [[""], ["root", "x"]]
    assert chat.conversations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_op11_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "</s>b"), (1, 0, "user", "a<s>"), (2, 0, "system", None), (2, 1, "assistant", "x"), (2, 2, "assistant", "é"), (3, 0, None, ""), (4, None, "user", "no turn"), (4, 0, "user", "no turn"), (4, 0, "user", "no turn"), (None, 0, "assistant", "y")]
    rows += [(5, k, "assistant" if k % 2 else "user", f"turn {k} [/INST]") for k in range(45)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    every = collections.defaultdict(list)
    control = "</s>[INST] ok [/INST]"
    for c, t, r, x in [*rows, (-7, 0, "user", control), (-7, 1, "assistant", control)]:
        every[c].append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in every.items():
        turns.sort()
        learned = "".join(x for *_, r, x in turns if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(learned), sha(learned))
    out = queries.QUERIES["op11_chat"](spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in out} == want and len(out) == len(want)


# clustering


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)) if groups[n] else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    each, digest = collections.Counter(), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    for _, far, n in found:
        each[n] += far
    return collections.Counter((i, n, far, each[n], sum(each.values()), digest[n]) for i, far, n in found)


def vector_rows(n):
    rng = random.Random(2)
    at = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in at[i % 9]]) for i in range(n)]
    rows += [(n + i, [float(i % 3 - 1)] * 64) for i in range(30)] + [(n, [0.0] * 64), (n, [0.0] * 64), (None, [0.5] * 64), (None, [-0.5] * 64)]  # ties, repeats, null ids
    return rows + [(n + 40, None), (n + 41, []), (n + 42, [1.0] * 63), (n + 43, [1.0] * 65), (n + 44, [None] + [1.0] * 63), (n + 45, [float("nan")] + [1.0] * 63), (n + 46, [float("inf")] + [1.0] * 63)]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [0, 400])
def test_op12_query(spark, tmp_path, n):
    rows = vector_rows(n) if n else vector_rows(2)[2:7]
    spark.createDataFrame([(*r, 0) for r in rows], VECTORS).repartition(3).selectExpr("*", "1 as cluster", "2 as distance").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.QUERIES["op12_annulus"](spark, str(tmp_path)).collect()
    assert collections.Counter(map(tuple, out)) == plain_clusters(rows)


def test_clusters_of_nothing_and_of_too_large(spark):
    clusters, centroids = clustering.cluster(spark.createDataFrame([], VECTORS))
    assert clustering.with_inertia(clusters, centroids).count() == 0 and not len(centroids)
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(spark.createDataFrame([(1, [3e37] * 64, 0)], VECTORS))


def test_annuli_hold_the_nearest():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 40):
        centroids = rng.integers(-9, 10, (k, 5)) * rng.integers(1, 4, (k, 1))
        vectors = np.concatenate([rng.integers(-30, 31, (500, 5)), centroids, 2 * centroids, np.zeros((1, 5), np.int64)])
        annuli = clustering.Annuli(centroids)
        number, least = annuli.nearest(vectors)
        every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert (least == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
        first, end = annuli.candidates(vectors)
        assert (end > first).all()
    spread = np.outer(np.arange(1, 41) * 10, np.ones(5, np.int64))  # norms tell these apart
    first, end = clustering.Annuli(spread).candidates(spread + rng.integers(-3, 4, spread.shape))
    assert (end - first).max() <= 3


# resampling


def plain_resampling(rows, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    features = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]  # noqa: B905, E731
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = collections.Counter(bucket(f) for r in rows for f in features(words(r[1])))
    t = collections.Counter(bucket(f) for x in target for f in features(words(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    scored = []
    for r in rows:
        w = words(r[1])
        f = features(w)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        scored.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    ranks = collections.defaultdict(list)
    for k, x in enumerate(able):
        ranks[x].append(k + 1 if k < 25 * len(able) // 100 else None)
    return collections.Counter((*x[:4], ranks[x].pop() if x[4] >= 20 else None) for x in scored)


def test_op13_query(spark, docs, rows, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(resampling, "RUN", 300)
    monkeypatch.setattr(resampling, "NODES", 500)
    target = [rows[0][1], rows[5][1].upper(), None, "", "one two one two"]
    docs.selectExpr("*", "1 as score", "2 as rank", "3 as bucket").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.QUERIES["op13_resampling"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, out.collect())) == plain_resampling(rows, target)
    few = resampling.resample(docs, nothing.select("text"), percent=100)
    assert few.where("rank is not null").count() == few.where("n_words >= 20").count() == resampling.drawn(docs, nothing.select("text"), percent=100).count()
    assert resampling.resample(nothing, docs).count() == 0


def test_tries_that_start_anew_lose_nothing(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x" * 40, "é"]) + str(rng.randrange(30)) for _ in range(700)).encode() for _ in range(5)]
    whole = resampling.Trie()
    for t in texts:
        whole.count(t)
    whole.hand_over()
    gains = [b % 97 - 40 for b in range(resampling.BUCKETS)]
    walks = [resampling.Trie(gains).walk(t) for t in texts]
    monkeypatch.setattr(resampling, "RUN", 50)
    monkeypatch.setattr(resampling, "NODES", 30)
    small, scorer = resampling.Trie(), resampling.Trie(gains)
    for t in texts:
        small.count(t)
    small.hand_over()
    assert small.totals == whole.totals and sum(whole.totals) == 5 * (2 * 700 - 1)
    assert [scorer.walk(t) for t in texts] == walks
