import random
import zlib

import pytest

TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=1, n=60):
    """Documents with nulls, empty texts, copies, near copies, repeated rows, junk and one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows = [(i, text(rng.randint(1, 150)), "en", f"s{i % 4}", 0) for i in range(n)]
    base = rows[0][1].split() + text(120).split()
    near = lambda k: " ".join(w if i % 90 != k % 90 else "changed" for i, w in enumerate(base))
    rows += [(n + k, near(k), "en", "s0", 0) for k in range(8)]
    rows += [(n + 8, rows[3][1], "en", "s1", 0), (n + 9, rows[3][1], "de", None, 0), (n + 9, rows[3][1], "de", None, 0)]
    rows += [(n + 10, None, None, None, None), (n + 11, "", "en", "s1", 0), (n + 12, " \t\n ", "en", "s1", 0), (None, text(60), "en", "s2", 0), (None, text(60), "en", "s2", 0)]
    rows += [(n + 13, text(20_000), "en", "s3", 0), (n + 14, "a@b.co it's\n\n  <|endoftext|> 日本 😀 +1 (555) 010-9999 4111 1111 1111 1111 10.0.0.255", "en", "s3", 0), (n + 15, "x" * 5000 + " same line\nsame line\nsame line #$%", "en", "s2", 0)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, TYPES).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], TYPES)


def crc(data: bytes) -> int:
    return zlib.crc32(data)
