"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 state machine.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each adjoining pair is the encoding of its
own bytes. So a nondeterministic transducer that walks the vocabulary's trie, may end a token wherever the trie has
one, and takes the next token only if the pair stands, has one accepting path for each input. It is determinised on
demand: a state is the set of (trie node, last token, tokens not yet emitted), a step emits what all its members have
in common, and states and steps are kept as they are met. A member lives for at most the longest token, so output waits
for a bounded lookahead only.

Defined results: a null text is an empty one and has no tokens; equal texts have equal ids; rows are independent, so
repeated rows and repeated or null ids keep their rows; an empty table gives an empty table; further columns, whatever
their names, are not read. Text of any length is worked through in pieces of bounded number.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.llm.arrays import as_arrow, pieces, texts
from urbangraph.llm.pretokens import Memory

#: Above every rank.
NEVER = 1 << 60

#: Steps that a worker keeps: some 90 MB with their states. Fewer take less memory and more time; results are the same.
MOST_STEPS = 300_000


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """most: steps kept, and verdicts on pairs. The first half of the steps, which are mostly the common ones, stays when the rest is
    forgotten and found anew; each KEEP-th time all are forgotten, so that the half that stays follows what the texts have become.

    A state is one flat tuple of node, last token and waiting tokens by turns, which takes half of what a tuple for each member takes.
    A step is its next state, or ~state if it emits tokens, which stand in `out`."""

    KEEP = 16

    def __init__(self, vocabulary: dict[bytes, int], most: int = MOST_STEPS):
        self.rank, self.bytes, self.most = vocabulary, {i: b for b, i in vocabulary.items()}, most
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for word, i in vocabulary.items():
            node = 0
            for b in word:
                self.inner[node] = True
                if (key := node << 8 | b) not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = i
        self.sides: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.times, self.first = 0, None
        self.forget()

    def forget(self, room: int = 0) -> None:
        """Makes room for so many steps."""
        if self.times % self.KEEP == 0 or self.first is None or self.first[1] + room > self.most:
            self.first = None
            self.states, self.steps, self.out = [(0, -1, ())], {}, {}
        else:
            n, m, k = self.first
            del self.states[n:]
            self.steps, self.out = dict(islice(self.steps.items(), m)), dict(islice(self.out.items(), k))
        self.known = {x: i for i, x in enumerate(self.states)}
        self.times += 1

    def merged(self, word: bytes) -> list[bytes]:
        """The plain rule: merge the adjoining pair of least rank, leftmost first, until none is in the vocabulary."""
        parts, get = [word[i : i + 1] for i in range(len(word))], self.rank.get
        while len(parts) > 1:
            best = [get(a + b, NEVER) for a, b in pairwise(parts)]
            least = min(best)
            if least == NEVER:
                break
            i = best.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edges(self, token: int, at: int) -> list[tuple[bytes, int]]:
        """The parts that stand at the left (at = 0) or right (at = -1) edge of a token while it is merged, each with
        the rank by which it goes into the next one. Empty if merging its bytes doesn't give the token."""
        if (token, at) not in self.sides:
            word, side = self.bytes[token], []
            parts, get = [word[i : i + 1] for i in range(len(word))], self.rank.get
            while len(parts) > 1:
                best = [get(a + b, NEVER) for a, b in pairwise(parts)]
                least = min(best)
                if least == NEVER:
                    break
                i = best.index(least)
                if i == (0 if at == 0 else len(parts) - 2):
                    side.append((parts[at], least))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.sides[token, at] = [*side, (word, NEVER)] if len(parts) == 1 else []
        return self.sides[token, at]

    def stands(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: nothing before): no merge across their border comes before both
        parts beside it have gone into larger ones."""
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            left, right = self.edges(a, -1) if a >= 0 else [(b"", NEVER)], self.edges(b, 0)
            found, i, j, get = bool(left and right), 0, 0, self.rank.get
            while found and a >= 0:
                (x, until_x), (y, until_y) = left[i], right[j]
                across = get(x + y, NEVER)
                if across < until_x and across <= until_y and across < NEVER:
                    found = False
                elif until_x == until_y == NEVER:
                    break
                elif until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = found
        return found

    def step(self, state: int, byte: int) -> int:
        new, waits, child, pairs = [], [], self.child, self.pairs
        members = iter(self.states[state])
        for node, last, wait in zip(members, members, members, strict=True):
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if self.inner[to]:
                new += to, last, wait
                waits.append(wait)
            token = self.token[to]
            if token >= 0 and (self.stands(last, token) if (known := pairs.get(last << 20 | token)) is None else known):
                wait = (*wait, token)
                new += 0, token, wait
                waits.append(wait)
        if out := waits[0]:
            for w in waits:
                while w[: len(out)] != out:
                    out = out[:-1]
        if out:
            new[2::3] = [w[len(out) :] for w in waits]
        key = tuple(new)
        to = self.known.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        at = state << 8 | byte
        if out:
            self.out[at], to = out, ~to
        self.steps[at] = to
        if self.first is None and 2 * len(self.steps) > self.most:
            self.first = len(self.states), len(self.steps), len(self.out)
        return to

    def encode(self, word: bytes) -> list[int]:
        if len(self.steps) + len(word) > self.most:
            self.forget(len(word))
        if len(self.pairs) > self.most:
            self.pairs.clear()
        out, state, get = [], 0, self.steps.get
        for byte in word:
            at = state << 8 | byte
            state = get(at)
            if state is None:
                state = self.step(at >> 8, byte)
            if state < 0:
                out += self.out[at]
                state = ~state
        return out + self.ending(state)

    def ending(self, state: int) -> list[int]:
        """The tokens still waiting where the text ends with a token's end."""
        members = iter(self.states[state])
        return next((list(wait) for node, _, wait in zip(members, members, members, strict=True) if node == 0), [])


class Utf8Stream:
    """Turns token ids into whole characters as they come. A state is the bytes of a character not yet complete.

    Bytes that can't belong to a character become U+FFFD, one for each longest part that could have begun one.
    """

    def __init__(self, vocabulary: dict[bytes, int]):
        self.bytes = {i: b for b, i in vocabulary.items()}
        self.steps: dict[bytes, dict[int, tuple[bytes, bytes]]] = {}

    @staticmethod
    def wanted(part: bytes) -> tuple[int, int, int]:
        """(bytes still missing, least and greatest next byte) after the first bytes of a character; -1 missing: invalid start."""
        lead = part[0]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        low, high = 0x80, 0xBF
        if len(part) == 1:  # neither overlong forms, nor surrogates, nor beyond U+10FFFF
            low, high = {0xE0: (0xA0, high), 0xED: (low, 0x9F), 0xF0: (0x90, high), 0xF4: (low, 0x8F)}.get(lead, (low, high))
        return size - len(part) if size else -1, low, high

    def step(self, part: bytes, data: bytes) -> tuple[bytes, bytes]:
        out = bytearray()
        for b in data:
            if part:
                missing, low, high = self.wanted(part)
                if low <= b <= high:
                    part += bytes([b])
                    if missing == 1:
                        out += part
                        part = b""
                    continue
                out += "�".encode()
                part = b""
            missing = self.wanted(bytes([b]))[0]
            if missing < 0:
                out += "�".encode()
            elif missing == 0:
                out.append(b)
            else:
                part = bytes([b])
        return bytes(out), part

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 bytes of all characters; at the end an incomplete one becomes U+FFFD."""
        out, part = [], b""
        table = self.steps.setdefault(part, {})
        for i in ids:
            found = table.get(i)
            if found is None:
                found = table[i] = self.step(part, self.bytes[i])
            out.append(found[0])
            if found[1] != part:
                part = found[1]
                if part not in self.steps and len(self.steps) > 4096:
                    self.steps.clear()
                table = self.steps.setdefault(part, {})
        return b"".join(out) + ("�".encode() if part else b"")


@lru_cache(1)
def encoder(path: str, most: int = MOST_STEPS) -> Memory:
    machine = Transducer(ranks(path), most)

    def encode(words: list[str]) -> list[list[int]]:
        return [machine.encode(w.encode()) for w in words]

    return Memory(encode)


@lru_cache(1)
def decoder(path: str) -> Utf8Stream:
    return Utf8Stream(ranks(path))


def ids_of(column: pa.Array, path: str, most: int = MOST_STEPS) -> pa.ListArray:
    counts, ids = encoder(path, most).tokens(texts(column))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def spelled(lists: pa.ListArray, path: str) -> pa.Array:
    stream = decoder(path)
    return pa.array([stream.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in lists], pa.binary())


def types(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and `ids` array<int>: the token ids of each whole text by the ranks in `path`."""

    def run(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids_of(batch.column("text"), path)], [*keep, "ids"])

    return as_arrow(df.select(*keep, F.col(text).alias("text")), run, f"{types(df, keep)}, ids array<int>")


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `ids`, and `decoded` binary: the UTF-8 bytes of the characters that the ids spell."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), part.column("ids"), spelled(part.column("ids"), path)], [*keep, "ids", "decoded"])

    return as_arrow(df, run, f"{types(df, keep)}, ids array<int>, decoded binary")


def round_trip(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = MOST_STEPS) -> DataFrame:
    """encode and decode in one pass, so that one worker a task holds the tables: `keep`, `ids`, `decoded`. most: as in Transducer."""

    def run(batches):
        for batch in pieces(batches):
            ids = ids_of(batch.column("text"), path, most)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids, spelled(ids, path)], [*keep, "ids", "decoded"])

    return as_arrow(df.select(*keep, F.col(text).alias("text")), run, f"{types(df, keep)}, ids array<int>, decoded binary")


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 in place of ids and decoded."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


