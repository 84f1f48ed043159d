"""Personal data: base patterns, and spans added by a semi-Markov conditional random field.

Base rules (leftmost, not overlapping, by kind) find e-mail addresses, IP addresses, payment cards and telephone numbers. The
field reads zones: tokens near such with a digit or an at sign. A candidate segment is up to LONGEST tokens whose first and
last have one; features of the whole segment (digits, groups, separators, checksums, ranges, words before it) score it for each
kind, tokens outside are segments of one token, and a dynamic program over ends and kinds, bounded by LONGEST, chooses the best
segmentation. Its segments are added where they overlap no base span. Text without digits and at signs has no zones.

The field is trained on the driver, on EXAMPLES made-up zones of both forms that the base rules know and forms that they
don't, with look-alikes between them, by stochastic gradient on the exact log-likelihood; the seed is fixed.

Defined results: a null or empty text has no spans and the digest of the empty string; repeated rows and null identifiers keep their
rows; an empty table gives an empty table; further columns are kept by `redact` and not read by `spans`.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urbangraph.llm.arrays import as_arrow, pieces, texts

KINDS = ("email", "ip", "card", "phone")
LONGEST, AROUND = 5, 2
EXAMPLES, EPOCHS = 500, 6

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> list[tuple[int, int]]:
    """What the whole pattern finds, from each at sign: the part before it is as long as can be. Linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if local else None
        if m:
            out.append((at - local, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(x := y.lstrip("0")) < 4 and int(x or 0) <= 255 for y in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


#: Words before a segment that hint at a kind.
CUES = {"email": ("mail", "email", "e-mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "mastercard"), "phone": ("phone", "tel", "call", "mobile", "fax")}
SHAPES = (
    ("domain", re.compile(r"^[^@\s]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")),
    ("at", re.compile(r"^[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")),
    ("national", re.compile(r"^\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$")),
    ("international", re.compile(r"^\+\d[\d ().-]+\d$")),
    ("fours", re.compile(r"^\d{4}([ .-]?\d{4}){2,3}$")),
    ("quad", re.compile(r"^\d{1,3}(\.\d{1,3}){3}$")),
    ("date", re.compile(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$")),
    ("decimal", re.compile(r"^\d+([.,]\d+)?%?$")),
    ("hex", re.compile(r"^[0-9a-f]{8,}$")),
)
NAMES = (
    ["bias", "@", "+", "(", "-", ".", "letters", "letters only", "digits only", "luhn", "no luhn", "quad in range", "quad out of range", "quotes or symbols"]
    + [f"shape {n}" for n, _ in SHAPES] + ["no shape"] + [f"digits {n}" for n in range(10)] + [f"tokens {n}" for n in range(1, LONGEST + 1)] + [f"cue {k}" for k in KINDS]
)
PLACE = {n: i for i, n in enumerate(NAMES)}
DIGIT_STEPS = (1, 4, 7, 9, 10, 12, 16, 17, 20)


class Zone:
    """Tokens (start, end in the text) and which of them may bound a segment."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens
        self.edge = [any(c.isdigit() and c.isascii() or c in "@+" for c in text[a:b]) or "at]" in text[a:b] or "(at)" in text[a:b] for a, b in tokens]
        self.found: dict[tuple[int, int], list[int]] = {}

    def bounds(self, i: int, j: int) -> tuple[int, int]:
        """Place in the text of tokens i to j without the marks around them."""
        a, b = self.tokens[i][0], self.tokens[j - 1][1]
        while a < b and self.text[a] in "\"'[<|{":
            a += 1
        while b > a and self.text[b - 1] in ".,;:!?\"'>]|}#$%&*":
            b -= 1
        return a, b

    def features(self, i: int, j: int) -> list[int]:
        if (i, j) not in self.found:
            a, b = self.bounds(i, j)
            s = re.sub(r"\s+", " ", self.text[a:b])
            d = digits_of(s)
            names = ["bias", *(c for c in "@+(-." if c in s)]
            if any(c.isalpha() for c in s):
                names.append("letters" if d else "letters only")
            elif d:
                names.append("digits only")
            if 12 <= len(d) <= 19:
                names.append("luhn" if luhn(d) else "no luhn")
            shapes = [n for n, p in SHAPES if p.match(s)]
            names += [f"shape {n}" for n in shapes] or ["no shape"]
            if "quad" in shapes:
                names.append("quad in range" if all(int(x) <= 255 for x in s.split(".")) else "quad out of range")
            if any(c in s for c in "\"'=$#*|&<>{}_/\\"):
                names.append("quotes or symbols")
            names += [f"digits {sum(len(d) >= n for n in DIGIT_STEPS)}", f"tokens {j - i}"]
            before = {self.text[x:y].lower().strip(".,:;") for x, y in self.tokens[max(0, i - 2) : i]}
            names += [f"cue {k}" for k in KINDS if before & set(CUES[k])]
            self.found[i, j] = [PLACE[n] for n in names]
        return self.found[i, j]

    def segments(self, j: int):
        """Starts of candidate segments that end before token j."""
        if self.edge[j - 1]:
            for i in range(max(0, j - LONGEST), j):
                if self.edge[i]:
                    yield i


#: Labels: the kinds, then outside.
OUTSIDE = len(KINDS)


class Field:
    """weights: features x kinds; moves: from label (the last row: the beginning) to label."""

    def __init__(self):
        self.weights, self.moves, self.outside = np.zeros((len(NAMES), OUTSIDE)), np.zeros((OUTSIDE + 2, OUTSIDE + 1)), np.zeros(2)

    def scores(self, z: Zone) -> list[list[tuple[int, np.ndarray]]]:
        """For each end the segments (start, score by label)."""
        out = []
        for j in range(1, len(z.tokens) + 1):
            alone = np.full(OUTSIDE + 1, -np.inf)
            alone[OUTSIDE] = self.outside[int(z.edge[j - 1])]
            here = [(j - 1, alone)]
            for i in z.segments(j):
                here.append((i, np.append(self.weights[z.features(i, j)].sum(0), -np.inf)))
            out.append(here)
        return out

    def best(self, z: Zone) -> list[tuple[int, int, int]]:
        """(first token, end, kind) of the best segmentation's entities."""
        scores, n = self.scores(z), len(z.tokens)
        value, back = [np.append(np.full(OUTSIDE + 1, -np.inf), 0.0)], [None]
        for here in scores:
            v, b = np.full(OUTSIDE + 2, -np.inf), [None] * (OUTSIDE + 1)
            for i, s in here:
                came = value[i][:, None] + self.moves
                frm = came.argmax(0)
                new = came[frm, np.arange(OUTSIDE + 1)] + s
                for y in np.flatnonzero(new > v[:-1]).tolist():
                    v[y], b[y] = new[y], (i, int(frm[y]))
            value.append(v)
            back.append(b)
        out, j, y = [], n, int(value[n][:-1].argmax()) if n else OUTSIDE
        while j:
            i, before = back[j][y]
            if y != OUTSIDE:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def learn(self, z: Zone, truth: list[tuple[int, int, int]], rate: float) -> None:
        """One step along the gradient of the log-likelihood of the true segmentation."""
        scores, n = self.scores(z), len(z.tokens)
        forward = [np.append(np.full(OUTSIDE + 1, -np.inf), 0.0)]
        for here in scores:
            a = np.full(OUTSIDE + 2, -np.inf)
            for i, s in here:
                a[:-1] = np.logaddexp(a[:-1], np.logaddexp.reduce(forward[i][:, None] + self.moves, 0) + s)
            forward.append(a)
        backward = [np.full(OUTSIDE + 2, -np.inf) for _ in range(n)] + [np.append(np.zeros(OUTSIDE + 1), -np.inf)]
        for j in range(n, 0, -1):
            for i, s in scores[j - 1]:
                backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(self.moves + s + backward[j][:-1], 1))
        whole = np.logaddexp.reduce(forward[n][:-1])
        d_moves, d_weights, d_outside = np.zeros_like(self.moves), np.zeros_like(self.weights), np.zeros(2)
        for j in range(1, n + 1):
            for i, s in scores[j - 1]:
                p = np.exp(forward[i][:, None] + self.moves + s + backward[j][:-1] - whole)
                d_moves -= p
                by_label = p.sum(0)
                if j - i == 1:
                    d_outside[int(z.edge[i])] -= by_label[OUTSIDE]
                if by_label[:OUTSIDE].any():
                    np.add.at(d_weights, z.features(i, j), -by_label[:OUTSIDE])
        at, before, spans = 0, OUTSIDE + 1, {i: (j, y) for i, j, y in truth}
        while at < n:
            j, y = spans.get(at, (at + 1, OUTSIDE))
            d_moves[before, y] += 1
            if y == OUTSIDE:
                d_outside[int(z.edge[at])] += 1
            else:
                np.add.at(d_weights, (z.features(at, j), y), 1)
            at, before = j, y
        self.moves += rate * d_moves
        self.weights += rate * d_weights
        self.outside += rate * d_outside


def examples(seed: int = 10) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up zones: text and the true (start, end, kind)."""
    rng, out = random.Random(seed), []

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(ok: bool) -> str:
        while True:
            d = rng.choice("3456") + number(15)
            if luhn(d) == ok:
                return d

    def fours(d: str, mark: str) -> str:
        return mark.join(d[i : i + 4] for i in range(0, 16, 4))

    def word() -> str:
        return "".join(rng.choice("abcdefghilmnoprstuvéü") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "", ",", "."])

    def name() -> str:
        return rng.choice([word().strip(",.") + "." + number(2), word().strip(",.") + number(1), "info" + number(2)])

    def host() -> str:
        return rng.choice(["mail", "post", "web"]) + number(1) + "." + rng.choice(["example", "test", "site"]) + "." + rng.choice(["com", "org", "net"])

    three = lambda: str(rng.randint(200, 999))
    makers = [
        (0, lambda: f"{name()}@{host()}"), (0, lambda: f"{name()}[at]{host()}"), (0, lambda: f"{name()} [at] {host()}"), (0, lambda: f"{name()}(at){host()}"),
        (1, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (2, lambda: card(True)), (2, lambda: fours(card(True), rng.choice(" -"))), (2, lambda: fours(card(True), ".")),
        (3, lambda: f"+1 ({three()}) {three()}-{number(4)}"), (3, lambda: f"+{rng.randint(20, 60)} {three()} {number(3)} {number(4)}"),
        (3, lambda: f"({three()}) {three()}-{number(4)}"), (3, lambda: f"{three()}-{three()}-{number(4)}"),
        (None, lambda: card(False)), (None, lambda: fours(card(False), " ")), (None, lambda: number(rng.randint(1, 8))), (None, lambda: f"{number(rng.randint(1, 3))}.{number(2)}"),
        (None, lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}"), (None, lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4))), (None, lambda: f"{number(1)}.{number(1)}.{number(1)}"),
        (None, lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 12, 32, 40])))), (None, lambda: f'"{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"'),
        (None, lambda: f"@{word().strip(',.')}"), (None, lambda: number(rng.randint(20, 30))), (None, lambda: f"{word()}{number(2)}"), (None, lambda: f"${number(3)}"), (None, lambda: number(rng.randint(9, 11))),
    ]
    cues = {0: "email", 1: "ip", 2: "card", 3: "phone"}
    for _ in range(EXAMPLES):
        text, spans = "", []
        for _ in range(rng.randint(1, 2)):
            text += "".join(word() + " " for _ in range(rng.randint(0, 3)))
            kind, make = rng.choice(makers)
            if kind is not None and rng.random() < 0.15:
                text += rng.choice(CUES[cues[kind]]) + ": "
            s = make()
            if kind is not None:
                spans.append((len(text), len(text) + len(s), kind))
            text += s + rng.choice([" ", ". ", ", "])
        out.append((text + "".join(word() + " " for _ in range(rng.randint(0, 2))), spans))
    return out


@lru_cache(1)
def train(seed: int = 10) -> Field:
    field, data = Field(), []
    for text, spans in examples(seed):
        z = Zone(text, [m.span() for m in TOKEN.finditer(text)])
        truth = []
        for a, b, k in spans:
            inside = [i for i, (x, y) in enumerate(z.tokens) if x < b and y > a]
            if 0 < len(inside) <= LONGEST and z.edge[inside[0]] and z.edge[inside[-1]]:
                truth.append((inside[0], inside[-1] + 1, k))
        data.append((z, truth))
    rng = random.Random(seed)
    for epoch in range(EPOCHS):
        rng.shuffle(data)
        for z, truth in data:
            field.learn(z, truth, 0.3 / (1 + epoch))
    return field


TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")


def zones(text: str):
    """Tokens with a trigger and those around them, joined where they touch."""
    tokens = None
    last, run = -1, []
    for m in TRIGGER.finditer(text):
        if m.start() < last:
            continue
        if tokens is None:
            tokens = [t.span() for t in TOKEN.finditer(text)]
            starts = np.array([t[0] for t in tokens])
        i = int(np.searchsorted(starts, m.start(), "right")) - 1
        last = tokens[i][1]
        if run and i - AROUND <= run[1]:
            run[1] = i + AROUND + 1
        else:
            if run:
                yield Zone(text, tokens[run[0] : run[1]])
            run = [max(0, i - AROUND), i + AROUND + 1]
    if run:
        yield Zone(text, tokens[run[0] : run[1]])


def added_spans(field: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, taken = [], np.array([(a, b) for a, b, _ in base]).reshape(-1, 2)
    for z in zones(text):
        for i, j, k in field.best(z):
            a, b = z.bounds(i, j)
            if a < b and not ((taken[:, 0] < b) & (taken[:, 1] > a)).any():
                out.append((a, b, k))
    return out


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    field = train()

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for t in texts(batch.column("text")):
                base = base_spans(t)
                every = base + added_spans(field, t, base)
                rows.append((*(sum(k == kind for _, _, kind in base) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
            types = (pa.int64(),) * 4 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", *names])

    doc_id = df.schema["doc_id"].dataType.simpleString()
    return as_arrow(df.selectExpr("doc_id", f"`{text}` as text"), run, f"doc_id {doc_id}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping ones the first, with all they cover."""
    out, at = [], 0
    for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of df, with personal data in the text replaced. A null text stays null."""
    field = train()

    def run(batches):
        for batch in pieces(batches, text):
            new = []
            for t in batch.column(text).to_pylist():
                if t:
                    base = base_spans(t)
                    t = redacted(t, base + added_spans(field, t, base))
                new.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return as_arrow(df, run, schema)
