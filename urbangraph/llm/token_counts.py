"""Token counts with a digest cache.

A text's content digest (SHA-256 of its UTF-8 bytes; null: empty) and the tokenizer's version digest (SHA-256 of its
file and its library's version) are the key of a stored count. Texts whose keys are not stored are encoded, each
distinct one once, and appended to the store, which is a folder of Parquet files; all counts then come from the store.

The library is asked for each distinct piece of its own split (see pretokens); a text that holds a special token's
string goes to the library whole. Defined results: null and empty texts have no tokens; repeated rows and null ids keep
their rows; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.llm.arrays import as_arrow, pieces, scratch, texts
from urbangraph.llm.pretokens import Memory

#: One thread a task, as Spark runs a task for each core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: How byte-level vocabularies write a space.
SPACE = "\u0120"
#: Words that the library is asked for in one text.
JOINED = 200
#: Pieces whose ids a worker remembers.
KEPT = 400_000

STORED = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Library:
    """Token ids as `tokenizers` gives them without added tokens, for many texts at once."""

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.memory = Memory(self.ask_pieces, KEPT)

    def ask(self, docs: list[str]) -> list[list[int]]:
        return [x.ids for i in range(0, len(docs), 1000) for x in self.tokenizer.encode_batch_fast(docs[i : i + 1000], add_special_tokens=False)]

    def ask_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece of the split. Words with a space before them are asked for JOINED at a time: the library splits them at that
        space, and no other token begins with one, so tokens that do tell the words apart. If their number were another, the words are asked for alone."""
        words = [i for i, s in enumerate(pieces) if s[0] == " " and s[1:].isalpha()]
        runs = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[list[int] | None] = [None] * len(pieces)
        for run, ids in zip(runs, self.ask(["".join([pieces[i] for i in run]) for run in runs]), strict=True):
            at = np.flatnonzero(self.begins[ids]).tolist()
            if len(at) == len(run):
                for i, a, b in zip(run, at, [*at[1:], len(ids)], strict=True):
                    out[i] = ids[a:b]
        alone = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(alone, self.ask([pieces[i] for i in alone]), strict=True):
            out[i] = ids
        return out

    def whole(self, doc: str) -> bool:
        return any(s in doc for s in self.special)

    def counts(self, docs: list[str]) -> np.ndarray:
        out = self.memory.count(["" if self.whole(d) else d for d in docs])
        for i, d in enumerate(docs):
            if self.whole(d):
                out[i] = len(self.ask([d])[0])
        return out

    def ids(self, docs: list[str]) -> list[np.ndarray]:
        counts, flat = self.memory.tokens(["" if self.whole(d) else d for d in docs])
        out = np.split(flat, np.cumsum(counts)[:-1])
        return [np.array(self.ask([d])[0], np.int32) if self.whole(d) else x for d, x in zip(docs, out, strict=True)]


@lru_cache(1)
def library(path: str) -> Library:
    return Library(path)


def content_digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def stored(spark, cache: str, version: str) -> DataFrame:
    try:
        kept = spark.read.schema(STORED).parquet(cache)
    except AnalysisException:  # no cache yet
        kept = spark.createDataFrame([], STORED)
    return kept.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(df: DataFrame, path: str, cache: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, n_bytes long, n_tokens long. cache: the folder of stored counts (null: a new one in the shared folder)."""
    spark, version, cache = df.sparkSession, tokenizer_digest(path), cache or scratch(df.sparkSession, "token-counts")
    docs = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("content_digest", content_digest())
    known = stored(spark, cache, version)
    misses = docs.select("content_digest", "text").join(known, "content_digest", "left_anti").groupBy("content_digest").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in pieces(batches):
            counts = library(path).counts(texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("content_digest"), pa.array([version] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    as_arrow(misses, run, STORED).write.mode("append").parquet(cache)
    return docs.select(*keep, F.octet_length("text").cast("long").alias("n_bytes"), "content_digest").join(stored(spark, cache, version), "content_digest").select(*keep, "n_bytes", "n_tokens")
