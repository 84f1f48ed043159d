"""Byte-level BPE's split into pieces as array operations, and a bounded memory of what each piece becomes.

The split is that of PATTERN (contractions; an optional space before letters, numbers or other characters; white
space, of which the last character before a word stays apart), written as rules about changes of character class.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from urbangraph.llm.arrays import run_hashes

WHITE, LETTER, NUMBER, OTHER, END = range(5)
STOP = 0x110000


@lru_cache(1)
def classes() -> np.ndarray:
    table = np.full(STOP + 1, OTHER, np.uint8)
    every = "".join(map(chr, range(STOP)))
    for kind, pattern in ((WHITE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[STOP] = END
    return table


def code_points(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, STOP after each one; the places of STOP."""
    cp = np.frombuffer(("\n".join(docs) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    stops = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1) - 1
    cp[stops] = STOP
    return cp, stops


def split(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, is a STOP) of all pieces, which cover cp."""
    c = classes()[cp]
    first = np.ones(len(c), bool)
    np.not_equal(c[1:], c[:-1], out=first[1:])
    first[c == END] = True
    last_white = np.flatnonzero((c[:-1] == WHITE) & (c[1:] != WHITE) & (c[1:] != END))
    first[last_white] = True
    first[last_white[cp[last_white] == 32] + 1] = False
    quote = np.flatnonzero(cp == 39)
    quote = quote[first[quote]]
    quote = quote[c[quote + 1] == LETTER]
    a, b = cp[quote + 1], cp[quote + 2]
    for n, here in ((2, np.isin(a, [ord(x) for x in "stmd"])), (3, ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))):
        first[quote[here] + 1] = False
        first[quote[here] + n] = True
    starts = np.flatnonzero(first)
    return starts, np.diff(starts, append=len(cp)), c[starts] == END


class Memory:
    """Token ids by piece. Before it would hold more than `most` pieces it forgets those after the first half, which are mostly the
    rarer ones; each KEEP-th time it forgets all."""

    KEEP = 16

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 200_000):
        self.encode, self.most, self.bits, self.times = encode, most, max(4, (2 * most).bit_length()), 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.counts, self.offsets, self.ids = np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, np.int64), np.zeros(1 << 20, np.int32)

    def forget(self) -> None:
        half = self.most // 2
        self.times += 1
        if self.times % self.KEEP == 0 or self.n <= half:
            self.clear()
            return
        stay = (self.keys != 0) & (self.slots < half)
        h, slots = self.keys[stay], self.slots[stay]
        self.keys[:] = 0
        self.n, self.used = half, int(self.offsets[half])
        self.put(h, slots)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        left, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, h: np.ndarray, slots: np.ndarray) -> None:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = free & (self.keys[at] == h)
            self.slots[at[mine]] = slots[mine]
            h, slots, at = h[~mine], slots[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def look_up(self, cp: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each piece; unknown pieces are encoded, each once."""
        h = np.where(h == 0, np.uint64(1), h)
        slot = self.find(h)
        missing = np.flatnonzero(slot < 0)
        if not len(missing):
            return slot
        fresh, at = np.unique(h[missing], return_index=True)
        if self.n + len(fresh) > self.most and self.n:
            self.forget()
            return self.look_up(cp, starts, lengths, h)
        if len(fresh) > self.most:
            self.most = len(fresh)
            self.bits = (2 * self.most).bit_length()
            self.clear()
        at = missing[at]
        found = self.encode([cp[s : s + n].tobytes().decode("utf-32-le", "surrogatepass") for s, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        slots = np.arange(self.n, self.n + len(found), dtype=np.int32)
        total = int(counts.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.int32, total)
        self.counts[slots], self.offsets[slots] = counts, self.used + np.cumsum(counts) - counts
        self.n, self.used = self.n + len(found), self.used + total
        self.put(fresh, slots)
        slot[missing] = self.find(h[missing])
        return slot

    def count(self, docs: list[str]) -> np.ndarray:
        """Tokens of each text."""
        return self.run(docs)[0]

    def run(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, slots of all pieces)."""
        cp, stops = code_points(docs)
        starts, lengths, stop = split(cp)
        h = run_hashes(cp, starts, lengths)[~stop]
        starts, lengths = starts[~stop], lengths[~stop]
        slots = self.look_up(cp, starts, lengths, h)
        total = np.concatenate([[0], np.cumsum(self.counts[slots])])
        at = np.searchsorted(starts, stops)
        return np.diff(total[at], prepend=0), slots

    def tokens(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, ids of all texts one after another)."""
        counts, slots = self.run(docs)
        n = self.counts[slots]
        return counts, self.ids[np.arange(int(n.sum())) + np.repeat(self.offsets[slots] - (np.cumsum(n) - n), n)]
