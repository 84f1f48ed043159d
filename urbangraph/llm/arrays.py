"""NumPy views of Arrow text columns, shared by the operators that work on whole texts inside tasks."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are taken together up to so many bytes, so that temporary arrays stay in the CPU's cache.
PIECE = 1 << 19


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; in tests, where it is unset, below /tmp."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = top or "file:///tmp/checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there: no executor's loss makes them be computed again, and the
    shuffles behind them can go once they are written."""
    path = scratch(df.sparkSession, name)
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Deletes the files of saved tables whose last reader is written."""
    for table in tables:
        session = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def keyed(df: DataFrame, column: str) -> bool:
    """Whether no value of the column is null or stands in two rows."""
    return not df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(column).isNull()).take(1)


#: Rows of a few numbers each that may be sent to all executors: some megabytes.
MOST_SENT = 200_000


def small(df: DataFrame) -> DataFrame:
    """A saved table of numbers, marked to be sent to all executors if it has at most MOST_SENT rows; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


class Recent:
    """Which 64-bit digests were not met before, as far as a table of fixed size remembers; others count as new again."""

    def __init__(self, bits: int = 17):
        self.shift, self.slots = np.uint64(64 - bits), np.zeros(1 << bits, np.uint64)

    def fresh(self, digests: np.ndarray) -> np.ndarray:
        """Places of the first of each new digest, in order."""
        values, first = np.unique(digests.view(np.uint64), return_index=True)
        at = (values >> self.shift).astype(np.int64)
        new = self.slots[at] != values
        self.slots[at[new]] = values[new]
        return np.sort(first[new])


#: Bytes of an Arrow batch between the JVM and Python: texts may be long, and batches of a number of rows large.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Memory that arrays have freed goes back to the system: Spark keeps workers for the tasks to come."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def as_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def each(batches):
        for batch in batches:
            yield batch
            give_back()

    def whole(batches):
        yield from run(each(batches))
        give_back()

    return df.mapInArrow(whole, schema)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches whose texts have about `limit` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD1342543DE82EF95)
    h ^= h >> np.uint64(32)
    return h


#: Odd multipliers, one for each place in a token; longer tokens start again with other digits.
PLACES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start : start + length] for adjoining runs that cover `values` in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    far = place >> 8
    weight = PLACES[place & 255]
    if far.any():
        weight = np.where(far > 0, mix(weight + far.astype(np.uint64)) | np.uint64(1), weight)
    h = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * weight, starts)
    return mix(h + lengths.astype(np.uint64) * PLACES[7])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of texts: (start, end, first word of each text with one more for the end)."""
    n = len(data)
    inside = np.zeros(n + 1, np.int8)
    inside[:n] = ~SPACE[data]
    change = np.diff(inside, prepend=np.int8(0))
    starts, ends = change == 1, change == -1
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    both = edges[(inside[edges] == 1) & (inside[edges - 1] == 1)]  # a word at the end of a text and one at the next one's start
    starts[both] = ends[both] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words. What lies between two words is hashed with factor 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    packed = np.zeros(len(data) + 1, np.int8)
    np.add.at(packed, starts, 1)
    np.add.at(packed, ends, -1)
    kept = data[np.cumsum(packed[:-1], dtype=np.int8).astype(bool)]
    return run_hashes(kept, np.cumsum(lengths) - lengths, lengths)
