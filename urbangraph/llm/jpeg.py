"""Progressive JPEG in numpy: a decoder for any progressive 8-bit Huffman file, and an encoder that stores bytes as coefficients.

The decoder adds up spectral-selection and successive-approximation scans in coefficient arrays (one row of 64 in
zigzag order for each block), dequantises and inverse-transforms them by one matrix product, upsamples chroma by
repetition and gives full-resolution RGB. A scan whose Huffman table has a single code has a fixed layout of bits and
is read as one array; any other scan is read code by code.

The encoder puts one byte into each coefficient: as it is at frequency zero, plus 256 elsewhere, so that no coefficient
but the first is zero and quantisation by 1 loses nothing. Chroma is subsampled 2 x 2 (six blocks of 64 bytes an MCU).
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_u, _x = np.mgrid[0:8, 0:8]
_BASIS = np.cos((2 * _x + 1) * _u * np.pi / 16) * np.where(_u == 0, np.sqrt(0.125), 0.5)
#: Row: coefficient in zigzag order; column: sample of the block.
INVERSE = np.einsum("ux,vy->uvxy", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG].astype(np.float32)
#: The same by SCALE as whole numbers: every machine gets the same samples.
SCALE = 8192.0
WHOLE = np.rint(INVERSE.astype(np.float64) * SCALE)

ACROSS = 1024
SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def one_code(kind: int, slot: int, symbol: int) -> bytes:
    """A Huffman table with the code 0 only."""
    return segment(0xC4, bytes([kind << 4 | slot, 1, *[0] * 15, symbol]))


def scan(components: list[int], first: int, last: int, high: int, low: int, bits: np.ndarray, slot: int = 0) -> bytes:
    body = bytes([len(components), *(x for c in components for x in (c, slot)), first, last, high << 4 | low])
    data = np.packbits(bits).tobytes()
    if pad := -len(bits) % 8:
        data = data[:-1] + bytes([data[-1] | (1 << pad) - 1])
    return segment(0xDA, body) + data.replace(b"\xff", b"\xff\x00")


def grid(mcus: int) -> tuple[int, int]:
    down = max(1, -(-mcus // ACROSS))
    return max(1, -(-mcus // down)), down


@lru_cache(256)
def mcu_order(across: int, down: int) -> np.ndarray:
    """Rows of all components' blocks (first 4 n of Y, then n of Cb, n of Cr) in the order of interleaved scans."""
    n = across * down
    y = np.arange(4 * n).reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(n, 4)
    c = np.arange(n)[:, None]
    return np.concatenate([y, 4 * n + c, 5 * n + c], 1).ravel()


HEAD = b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64]))
TABLES = one_code(0, 0, 0) + one_code(1, 0, 8) + one_code(1, 1, 0)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG file whose coefficients are these bytes; their number goes into a comment."""
    across, down = grid(-(-len(payload) // 384))
    blocks = np.full((6 * across * down, 64), 32, np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    n = across * down
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in SAMPLING)
    out = [HEAD, segment(0xFE, b"payload %d" % len(payload)), segment(0xC2, frame), TABLES]
    planes = np.unpackbits(blocks[mcu_order(across, down), 0][None], axis=0).reshape(8, -1)
    out.append(scan([1, 2, 3], 0, 0, 0, 8, np.zeros(6 * n, np.uint8)))
    out += [scan([1, 2, 3], 0, 0, low + 1, low, planes[7 - low]) for low in range(7, -1, -1)]
    for i, part in ((1, blocks[: 4 * n]), (2, blocks[4 * n : 5 * n]), (3, blocks[5 * n :])):
        bits = np.zeros((len(part), 63, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(((part[:, 1:] >> 1) | 128).reshape(-1)).reshape(len(part), 63, 8)
        bands = ((1, 5), (6, 63)) if i == 1 else ((1, 63),)
        out += [scan([i], a, b, 0, 1, bits[:, a - 1 : b].reshape(-1)) for a, b in bands]
        last = np.zeros((len(part), 64), np.uint8)
        last[:, 1:] = part[:, 1:] & 1
        out.append(scan([i], 1, 63, 1, 0, last.ravel(), slot=1))
    return b"".join([*out, b"\xff\xd9"])


class Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return out

    def code(self, table: dict[tuple[int, int], int]) -> int:
        word = 0
        for n in range(1, 17):
            word = word << 1 | self.take(1)
            if (n, word) in table:
                return table[n, word]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@lru_cache(256)
def alone(across: int, down: int, stride: int) -> np.ndarray:
    return (np.arange(down)[:, None] * stride + np.arange(across)).ravel()


@lru_cache(256)
def together(across: int, down: int, h: int, v: int) -> np.ndarray:
    return np.arange(across * h * down * v).reshape(down, v, across, h).transpose(0, 2, 1, 3).reshape(down * across, -1)


class Component:
    def __init__(self, slot: int, h: int, v: int, quantiser: int):
        self.slot, self.h, self.v, self.quantiser = slot, h, v, quantiser


class Image:
    """The coefficient arrays of one file, and what they show."""

    def __init__(self, data: bytes):
        self.quantisers, self.tables, self.components, self.comment, self.restart = {}, {}, {}, b"", 0
        self.read(data)

    def read(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        marks = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[marks + 1]
        marks = marks[(after != 0) & ((after < 0xD0) | (after > 0xD7))].tolist()
        next_mark, at = 0, 2
        while data[at + 1] != 0xD9:
            kind, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDA:
                while marks[next_mark] < at:
                    next_mark += 1
                self.scan(body, data[at : marks[next_mark]])
                at = marks[next_mark]
            elif kind == 0xC4:
                self.huffman(body)
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                    body = body[1 + 64 * (1 + wide) :]
            elif kind == 0xC2:
                self.frame(body)
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif kind == 0xFE:
                self.comment = body
            elif 0xC0 <= kind <= 0xCF:
                raise ValueError("not a progressive Huffman file")

    def huffman(self, body: bytes) -> None:
        while body:
            counts, n, word, table = body[1:17], 17, 0, {}
            for length, count in enumerate(counts, 1):
                for symbol in body[n : n + count]:
                    table[length, word] = symbol
                    word += 1
                n, word = n + count, word << 1
            self.tables[body[0]] = table
            body = body[n:]

    def frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8:
            raise ValueError("not 8 bits a sample")
        parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
        self.most_h, self.most_v = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
        self.across, self.down = -(-self.width // (8 * self.most_h)), -(-self.height // (8 * self.most_v))
        for slot, (i, hv, q) in enumerate(parts):
            c = self.components[i] = Component(slot, hv >> 4, hv & 15, q)
            c.stride, c.rows = self.across * c.h, self.down * c.v
            c.used = -(-(-(-self.width * c.h // self.most_h)) // 8), -(-(-(-self.height * c.v // self.most_v)) // 8)
            c.coefficients = np.zeros((c.stride * c.rows, 64), np.int16)

    def order(self, parts: list[Component]) -> list[np.ndarray]:
        """For each component of a scan its blocks in the order of the scan; MCU by MCU if there are several."""
        if len(parts) == 1:
            c = parts[0]
            across, down = c.used
            return [alone(across, down, c.stride)]
        return [together(self.across, self.down, c.h, c.v) for c in parts]

    def scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        parts = [self.components[body[1 + 2 * i]] for i in range(n)]
        slots = [body[2 + 2 * i] for i in range(n)]
        first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
        high, low = approximation >> 4, approximation & 15
        order = self.order(parts)
        if not self.restart and self.scan_at_once(parts, slots, first, last, high, low, order, data):
            return
        pieces, start = [], 0
        for at in np.flatnonzero(np.frombuffer(data, np.uint8)[:-1] == 0xFF).tolist() if self.restart else []:
            if 0xD0 <= data[at + 1] <= 0xD7:
                pieces.append(data[start:at])
                start = at + 2
        pieces.append(data[start:])
        units = len(order[0])
        step = self.restart or units
        for k, piece in enumerate(pieces):
            bits, self.ends, before = Bits(piece.replace(b"\xff\x00", b"\xff")), 0, [0] * n
            for unit in range(k * step, min(units, (k + 1) * step)):
                for i, c in enumerate(parts):
                    for block in np.atleast_1d(order[i][unit]).tolist():
                        row = c.coefficients[block]
                        if first == 0 and high == 0:
                            before[i] += bits.signed(bits.code(self.tables[slots[i] >> 4]))
                            row[0] = before[i] << low
                        elif first == 0:
                            row[0] |= bits.take(1) << low
                        elif high == 0:
                            self.ac_first(bits, row, self.tables[16 | slots[i] & 15], first, last, low)
                        else:
                            self.ac_refine(bits, row, self.tables[16 | slots[i] & 15], first, last, low)

    def scan_at_once(self, parts, slots, first, last, high, low, order, data) -> bool:
        if first and len(table := self.tables[16 | slots[0] & 15]) == 1:
            ((length, _), symbol), c, rows, band = next(iter(table.items())), parts[0], order[0], last - first + 1
            where = slice(None) if len(rows) == len(c.coefficients) else rows
            if length != 1 or high == 0 and not 0 < symbol < 16 or high and symbol:
                return False
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
            if high == 0:  # run 0 and the same size everywhere
                values = bits[: len(rows) * band * (1 + symbol)].reshape(len(rows), band, 1 + symbol)[:, :, 1:]
                v = np.packbits(values.reshape(-1)).reshape(len(rows), band).astype(np.int32) if symbol == 8 else values @ (1 << np.arange(symbol - 1, -1, -1))
                if not v.size or v.min() < 1 << (symbol - 1):
                    v = np.where(v >> (symbol - 1), v, v - (1 << symbol) + 1)
                c.coefficients[where, first : last + 1] = v * (1 << low)
                return True
            old = c.coefficients[where, first : last + 1]
            if old.size and old.min() > 0:
                c.coefficients[where, first : last + 1] = old + (bits[: len(rows) * (1 + band)].reshape(len(rows), -1)[:, 1:] << low)
                return True
            # each block: an end-of-block code, then a bit for each coefficient that isn't zero
            there = np.ones((len(rows), 1 + band), bool)
            np.not_equal(old, 0, out=there[:, 1:])
            add = np.zeros(there.shape, np.int32)
            add[there] = bits[: int(there.sum())]
            c.coefficients[where, first : last + 1] = old + np.where(old < 0, -1, 1) * (add[:, 1:] << low)
            return True
        if first == 0 and high:
            flat = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).astype(np.int16) << low
            each = [1 if len(parts) == 1 else o.shape[1] for o in order]
            units = len(order[0])
            flat = flat[: units * sum(each)].reshape(units, -1)
            at = 0
            for c, o, k in zip(parts, order, each, strict=True):
                c.coefficients[o.ravel(), 0] |= flat[:, at : at + k].ravel()
                at += k
            return True
        return first == 0 and high == 0 and all(self.tables[s >> 4] == {(1, 0): 0} for s in slots)  # all differences are zero

    def ac_first(self, bits, row, table, first, last, low) -> None:
        if self.ends:
            self.ends -= 1
            return
        k = first
        while k <= last:
            symbol = bits.code(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                row[k + run] = bits.signed(size) * (1 << low)
                k += run + 1
            elif run == 15:
                k += 16
            else:
                self.ends = (1 << run) - 1 + bits.take(run)
                return

    def ac_refine(self, bits, row, table, first, last, low) -> None:
        one, k = 1 << low, first

        def correct(i: int) -> None:
            if bits.take(1):
                row[i] += one if row[i] > 0 else -one

        while k <= last and not self.ends:
            symbol = bits.code(table)
            run, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif run < 15:
                self.ends = (1 << run) + bits.take(run)
                break
            while k <= last:
                if row[k]:
                    correct(k)
                elif run == 0:
                    if new:
                        row[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if self.ends:
            for i in range(k, last + 1):
                if row[i]:
                    correct(i)
            self.ends -= 1

    def payload(self) -> bytes:
        """What encode() was given."""
        n = int(self.comment.split()[1])
        return np.concatenate([c.coefficients.astype(np.uint8) for c in self.components.values()]).reshape(-1)[:n].tobytes()

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8 bits a sample; one component gives three equal ones."""
        planes = []
        for c in self.components.values():
            sums = (c.coefficients * self.quantisers[c.quantiser]).astype(np.float64) @ WHOLE  # of whole numbers below 2^53, so exact in any order
            samples = np.clip(np.floor((sums + SCALE / 2) / SCALE), -16384, 16384).astype(np.int32)
            plane = samples.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.stride)
            if (v := self.most_v // c.v) > 1:
                plane = np.repeat(plane, v, 0)
            if (h := self.most_h // c.h) > 1:
                plane = np.repeat(plane, h, 1)
            planes.append(plane[: self.height, : self.width])
        y = planes[0] + 128
        if len(planes) < 3:
            planes = [y, y, y]
        else:
            cb, cr = planes[1:3]
            planes = [y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 32768 >> 16) - (46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16)]  # 1.402, 0.344136, 0.714136, 1.772 by 2^16
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, p in enumerate(planes):
            out[:, :, i] = np.clip(p, 0, 255)
        return out
