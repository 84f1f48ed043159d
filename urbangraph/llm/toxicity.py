"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is a learned vector of its hash bucket beside the mean of learned vectors of its character 4-grams (as
bytes, hashed, with the space before the word). Both kinds begin with a log-odds of toxic and other sample documents. A text's words are
cut into overlapping windows of WINDOW words, one every STRIDE words, the last one shorter; every window is scored,
and a text's score is its highest window's. Trained on a bounded sample of labelled documents; as a label is about a whole
document, each pass takes the window that scores highest at present, at first by the log-odds, as the document's example
(for clean ones also another one at random).

Sample: at most TOXIC_MOST toxic and CLEAN_MOST other labelled documents of at most CHARS_MOST characters, those of least digest,
never such whose crc32(doc_id as text) mod 5 is 0. Scores are rounded to 6 digits. The input of a score is the text only.

Defined results: a text without words, null or empty, scores 0; without labelled documents of both kinds every text scores 0;
a null doc_id counts as held out; repeated rows keep their rows; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.llm.arrays import LOWER, as_arrow, pieces, utf8, word_hashes, words

WINDOW, STRIDE = 48, 32
BUCKETS, WIDE, HIDDEN = 1 << 15, 8, 8
TOXIC_MOST, CLEAN_MOST, CHARS_MOST = 1500, 3000, 4000
STEPS, BATCH, RATE, AGAIN = 300, 128, 0.01, 100
#: Windows that are scored together.
TOGETHER = 4096

Model = dict[str, np.ndarray]


def begin(seed: int = 5) -> Model:
    rng, h = np.random.default_rng(seed), HIDDEN
    shapes = {"words": (BUCKETS, WIDE), "grams": (BUCKETS, WIDE), "in_f": (2 * WIDE, 3 * h), "in_b": (2 * WIDE, 3 * h), "b_f": (3 * h,), "b_b": (3 * h,), "u_f": (h, 3 * h), "u_b": (h, 3 * h), "att": (2 * h, h), "b_att": (h,), "v": (h,), "out": (2 * h,), "bias": (1,)}
    return {k: (np.zeros(s) if k.startswith("b_") or k == "bias" else rng.normal(0, 0.1 if k in ("words", "grams") else 0.3, s)).astype(np.float32) for k, s in shapes.items()}


class Texts:
    """Words of many texts as hash buckets and 4-grams, and their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        starts, ends, first = words(data, offsets)
        self.buckets = (word_hashes(data, starts, ends) >> np.uint64(49)).astype(np.int64)
        self.starts, self.lengths = starts, ends - starts  # starts: in these texts' bytes
        self.grams = grams(data, starts, self.lengths)
        self.before = np.cumsum(self.lengths) - self.lengths
        n = np.diff(first)
        windows = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        self.first = np.concatenate([[0], np.cumsum(windows)])
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], windows)
        self.at = np.repeat(first[:-1], windows) + place * STRIDE
        self.size = np.minimum(WINDOW, np.repeat(first[1:], windows) - self.at)

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """The same from blocks of texts, so that what is needed meanwhile stays small."""
        parts = [cls(*utf8(column.slice(i, BLOCK))) for i in range(0, max(len(column), 1), BLOCK)]
        out = cls.__new__(cls)
        for name in ("buckets", "starts", "lengths", "grams", "size"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        out.before = np.cumsum(out.lengths) - out.lengths
        words_before = np.cumsum([0, *(len(p.buckets) for p in parts)])
        out.at = np.concatenate([p.at + n for p, n in zip(parts, words_before[:-1], strict=True)])
        out.first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
        return out

    def some_grams(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(4-grams of these words one after another, where each word's begin)."""
        lengths = self.lengths[of]
        at = np.cumsum(lengths) - lengths
        return self.grams[np.arange(int(lengths.sum())) + np.repeat(self.before[of] - at, lengths)], at

    def inputs(self, model: Model, of: np.ndarray | None = None) -> np.ndarray:
        """A row of 2 * WIDE numbers for each word."""
        if not len(self.starts):
            return np.zeros((0, 2 * WIDE), np.float32)
        chars, at = (self.grams, self.before) if of is None else self.some_grams(of)
        lengths, buckets = (self.lengths, self.buckets) if of is None else (self.lengths[of], self.buckets[of])
        return np.concatenate([model["words"][buckets], np.add.reduceat(model["grams"][chars], at) / lengths[:, None].astype(np.float32)], 1)


def grams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bucket of the four bytes that end at each byte of each word; what comes before the word counts as spaces."""
    before = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.int32)
    for i in range(0, len(starts), 1 << 16):
        some = slice(i, i + (1 << 16))
        n = lengths[some]
        place = np.arange(int(n.sum())) - np.repeat(before[some] - before[i], n)
        at = np.repeat(starts[some], n) + place
        value = data[at].astype(np.uint32)
        for back in (1, 2, 3):
            value |= np.where(place >= back, data[np.maximum(at - back, 0)], 32).astype(np.uint32) << np.uint32(8 * back)
        out[before[i] : before[i] + len(at)] = (value * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def states(x: np.ndarray, rows: np.ndarray, sizes: np.ndarray, u: np.ndarray, way: int) -> np.ndarray:
    """All states (WINDOW, windows, HIDDEN) of one direction. x: input parts by word; sizes descend, so that at step t the
    windows still running come first; a state stands at its word's place."""
    h, hidden = HIDDEN, np.zeros((len(rows), HIDDEN), np.float32)
    out = np.zeros((WINDOW, len(rows), h), np.float32)
    for t in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, "left"))
        place = np.full(n, t) if way > 0 else sizes[:n] - 1 - t
        now = hidden[:n]
        part, back = x[rows[:n] + place], now @ u
        gates = sigmoid(part[:, : 2 * h] + back[:, : 2 * h])
        z = gates[:, :h]
        new = np.tanh(part[:, 2 * h :] + gates[:, h:] * back[:, 2 * h :])
        hidden[:n] = new + z * (now - new)
        if way > 0:
            out[t, :n] = hidden[:n]
        else:
            out[place, np.arange(n)] = hidden[:n]
    return out


def score_windows(model: Model, t: Texts) -> np.ndarray:
    """A logit for each window."""
    x = t.inputs(model)
    forward, backward = x @ model["in_f"] + model["b_f"], x @ model["in_b"] + model["b_b"]
    order, out = np.argsort(-t.size, kind="stable"), np.zeros(len(t.size), np.float32)
    for i in range(0, len(order), TOGETHER):
        some = order[i : i + TOGETHER]
        rows, sizes = t.at[some], t.size[some]
        h = np.concatenate([states(forward, rows, sizes, model["u_f"], 1), states(backward, rows, sizes, model["u_b"], -1)], 2)
        e = np.tanh(h @ model["att"] + model["b_att"]) @ model["v"]
        e = np.where(np.arange(WINDOW)[:, None] < sizes, np.exp(e), 0)
        out[some] = np.einsum("tn,tn->n", e, h @ model["out"]) / e.sum(0) + model["bias"]
    return out


def score_texts(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    if model is None:
        return out
    t = Texts(data, offsets)
    some = np.flatnonzero(np.diff(t.first))
    if len(some):
        out[some] = np.round(sigmoid(np.maximum.reduceat(score_windows(model, t), t.first[some]).astype(np.float64)), 6)
    return out


def gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray):
    """x (steps, windows, 3 h), mask (steps, windows, 1): states and what the way back needs."""
    h, hidden, kept, out = HIDDEN, np.zeros((x.shape[1], HIDDEN), np.float32), [], []
    for part, m in zip(x, mask, strict=True):
        back = hidden @ u
        gates = sigmoid(part[:, : 2 * h] + back[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(part[:, 2 * h :] + r * back[:, 2 * h :])
        kept.append((hidden, back[:, 2 * h :], z, r, new))
        hidden = hidden + m * (1 - z) * (new - hidden)
        out.append(hidden)
    return np.stack(out), kept


def gru_back(d_out: np.ndarray, kept, u: np.ndarray, mask: np.ndarray):
    d_hidden, d_u, d_x = np.zeros_like(d_out[0]), np.zeros_like(u), np.zeros((*d_out.shape[:2], 3 * HIDDEN), np.float32)
    for t in range(len(kept) - 1, -1, -1):
        hidden, back, z, r, new = kept[t]
        d = d_hidden + d_out[t]
        d_step = d * mask[t]
        d_new = d_step * (1 - z) * (1 - new * new)
        d_z = d_step * (hidden - new) * z * (1 - z)
        d_r = d_new * back * r * (1 - r)
        d_x[t] = np.concatenate([d_z, d_r, d_new], 1)
        d_back = np.concatenate([d_z, d_r, d_new * r], 1)
        d_u += hidden.T @ d_back
        d_hidden = d - d_step * (1 - z) + d_back @ u.T
    return d_x, d_u


def gradients(model: Model, t: Texts, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """Of the weighted cross entropy of these windows."""
    sizes, at = t.size[windows], t.at[windows]
    steps, n, h = int(sizes.max()), len(windows), HIDDEN
    place = np.arange(steps)[:, None]
    mask = (place < sizes).astype(np.float32)[:, :, None]
    forth = at + np.minimum(place, sizes - 1)
    reverse = np.maximum(sizes - 1 - place, 0)
    used, inverse = np.unique(forth, return_inverse=True)
    x = t.inputs(model, used)
    rows_f = inverse.reshape(forth.shape)
    rows_b = rows_f[reverse, np.arange(n)]
    out_f, kept_f = gru((x @ model["in_f"] + model["b_f"])[rows_f], model["u_f"], mask)
    out_b, kept_b = gru((x @ model["in_b"] + model["b_b"])[rows_b], model["u_b"], mask)
    hidden = np.concatenate([out_f, out_b[reverse, np.arange(n)]], 2)  # a state of the way back stands at its word's place
    inner = np.tanh(hidden @ model["att"] + model["b_att"])
    e = np.where(mask[:, :, 0] > 0, np.exp(inner @ model["v"]), 0)
    a = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", a, hidden)
    d_logit = ((sigmoid(pooled @ model["out"] + model["bias"]) - labels) * weights / weights.sum()).astype(np.float32)
    d_pooled = d_logit[:, None] * model["out"]
    d_a = np.einsum("nh,tnh->tn", d_pooled, hidden)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_inner = d_e[:, :, None] * model["v"] * (1 - inner * inner)
    d_hidden = a[:, :, None] * d_pooled + d_inner @ model["att"].T
    g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True), "v": np.einsum("tnk,tn->k", inner, d_e), "att": np.einsum("tnh,tnk->hk", hidden, d_inner), "b_att": d_inner.sum((0, 1))}
    d_f, g["u_f"] = gru_back(d_hidden[:, :, :h] * mask, kept_f, model["u_f"], mask)
    d_b, g["u_b"] = gru_back((d_hidden[:, :, h:] * mask)[reverse, np.arange(n)] * mask, kept_b, model["u_b"], mask)
    d_x = np.zeros_like(x)
    for d, rows, k in ((d_f, rows_f, "f"), (d_b, rows_b, "b")):
        g[f"b_{k}"] = d.sum((0, 1))
        by_row = np.zeros((len(used), 3 * h), np.float32)
        np.add.at(by_row, rows.ravel(), d.reshape(-1, 3 * h))
        g[f"in_{k}"] = x.T @ by_row
        d_x += by_row @ model[f"in_{k}"].T
    g["words"], g["grams"] = np.zeros_like(model["words"]), np.zeros_like(model["grams"])
    np.add.at(g["words"], t.buckets[used], d_x[:, :WIDE])
    chars, _ = t.some_grams(used)
    np.add.at(g["grams"], chars, np.repeat(d_x[:, WIDE:] / t.lengths[used][:, None], t.lengths[used], axis=0))
    return g


def log_odds(held: np.ndarray, count: tuple[int, int]) -> np.ndarray:
    """By bucket, of the shares of the `count` other and toxic documents that hold it, drawn to 0 where few do."""
    share = (held + 2 * (held.sum(0) + 1) / sum(count)) / np.array([[max(1, n)] for n in count])
    return (np.log(share[1] / share[0]) * held.sum(0) / (held.sum(0) + 5)).astype(np.float32)


#: Sample documents that are looked at together.
BLOCK = 128


def train(docs: list[str], labels: list[int], steps: int = STEPS, seed: int = 5) -> Model | None:
    """None without documents of both kinds."""
    column = pa.array(docs, pa.string())
    t, toxic = Texts.of(column), np.array(labels, np.float32)
    filled = np.flatnonzero(np.diff(t.first))
    bad, good = filled[toxic[filled] == 1], filled[toxic[filled] == 0]
    if not len(bad) or not len(good):
        return None
    model, rng = begin(seed), np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    half, blocks = BATCH // 2, [(range(i, min(i + BLOCK, len(docs))), column.slice(i, BLOCK)) for i in range(0, len(docs), BLOCK)]
    held = {k: np.zeros((2, BUCKETS)) for k in ("words", "grams")}
    for rows, part in blocks:
        p, first = Texts(*utf8(part)), words(*utf8(part))[2]
        before = np.concatenate([p.before, [len(p.grams)]])
        for i, d in enumerate(rows):
            held["words"][int(toxic[d]), np.unique(p.buckets[first[i] : first[i + 1]])] += 1
            held["grams"][int(toxic[d]), np.unique(p.grams[before[first[i]] : before[first[i + 1]]])] += 1
    for k, h in held.items():
        model[k][:, 0] = log_odds(h, (int((toxic == 0).sum()), int((toxic == 1).sum())))

    def highest(p: Texts) -> np.ndarray:
        x = p.inputs(model)
        top = x[:, 0] + x[:, WIDE]
        return np.array([top[a : a + n].max() for a, n in zip(p.at.tolist(), p.size.tolist(), strict=True)])

    for step in range(1, steps + 1):
        if step % AGAIN == 1:
            logits = np.concatenate([(score_windows if step > 1 else lambda m, p: highest(p))(model, Texts(*utf8(part))) for _, part in blocks])
            best = {d: t.first[d] + int(np.argmax(logits[t.first[d] : t.first[d + 1]])) for d in filled.tolist()}
        some = np.concatenate([rng.choice(bad, half), rng.choice(good, half)])
        windows = np.array([best[d] if toxic[d] or i % 2 else rng.integers(t.first[d], t.first[d + 1]) for i, d in enumerate(some.tolist())])
        g = gradients(model, t, windows, toxic[some], np.ones(len(some), np.float32))
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, v in model.items():
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.001 * (g[k] * g[k] - square[k])
            v -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def sample(df: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample of labelled texts."""
    known = labels.select("doc_id", "toxic").where(~held_out() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = known.where("toxic = 1").orderBy(*order).limit(2 * TOXIC_MOST).union(known.where("toxic = 0").orderBy(*order).limit(2 * CLEAN_MOST))
    short = df.select("doc_id", "text").where(F.char_length("text") <= CHARS_MOST)
    found = short.join(F.broadcast(chosen), "doc_id")  # a fixed number of rows is sent
    parts = [found.where(F.col("toxic") == k).orderBy(*order, "text").limit(most) for k, most in ((1, TOXIC_MOST), (0, CLEAN_MOST))]
    return sorted((r["text"], r["toxic"]) for part in parts for r in part.select("text", "toxic").collect())


def fit(df: DataFrame, labels: DataFrame) -> Model | None:
    rows = sample(df, labels)
    return train([r[0] for r in rows], [r[1] for r in rows])


def score(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of df, and `name` double, which df must not have."""

    def run(batches):
        for batch in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(model, *utf8(batch.column(text))))], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return as_arrow(df, run, f"{schema}, `{name}` double")


def toxicity(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int."""
    scored = score(df.select("doc_id", "text"), fit(df, labels)).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
