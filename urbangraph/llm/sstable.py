"""Token ids as sorted-string-table shards.

A shard is one file: blocks of entries in key order, then a block index, a Bloom filter of the keys and a footer.

    block   zstd of entries: shared (varint), rest length (varint), value length (varint), rest of key, value
    index   for each block: first key (13 bytes), offset (8), length (4), all big-endian
    Bloom   8 bits a key, 5 probes
    footer  last key (13), entries (8), ids (8), index offset (8), Bloom offset (8), end of Bloom (8), magic (8)

A key is a byte that is 0 for a null identifier and 1 for others, the identifier as 8 big-endian bytes with the sign bit flipped, and 4 bytes that
number repeats of one identifier, so that byte order is identifier order, null first; `shared` is how many bytes it has in common with the key before it.
A value is the document's ids as little-endian unsigned 32-bit integers. `lookup` finds a document by binary search in
the shards' ranges, which opens as many shards as the logarithm of their number, and in the block index after asking the Bloom filter.

Shards come from a range partitioning by identifier; each task writes its own file under a temporary name and renames
it, so that a task run again leaves the same file. Files go through pyarrow.fs to the folder's own file system.

Defined results: null and empty texts have the end token only; null identifiers are the least key; rows that repeat an identifier
are all stored, in an order by their contents; an empty table writes no shard; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbangraph.llm.arrays import as_arrow, pieces, saved, scratch, texts
from urbangraph.llm.token_counts import library

MAGIC = b"ugsst\x00\x00\x02"
KEY = struct.Struct(">BQI")
FOOTER = struct.Struct(f">{KEY.size}sQQQQQ8s")
BLOCK = struct.Struct(f">{KEY.size}sQI")
#: Bytes of a key without the number of the repeat.
NAME = KEY.size - 4
#: Bytes of entries in a block before it is compressed.
BLOCK_BYTES = 1 << 16


def key_of(doc_id: int | None, again: int = 0) -> bytes:
    return KEY.pack(0, 0, again) if doc_id is None else KEY.pack(1, doc_id + (1 << 63), again)


def id_of(key: bytes) -> int | None:
    there, i, _ = KEY.unpack(key)
    return i - (1 << 63) if there else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key[::-1], 0x5BD1) | 1
    return [(a + i * b) % bits for i in range(5)]


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Writer:
    def __init__(self, out):
        self.out, self.offset, self.entries, self.ids = out, 0, 0, 0
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.index, self.keys = [], []
        self.packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        """Keys must come in ascending order."""
        if not self.block:
            self.first, self.last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.last = key
        self.keys.append(key)
        self.entries, self.ids = self.entries + 1, self.ids + len(value) // 4
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.packer.compress(b"".join(self.block))
            self.index.append(BLOCK.pack(self.first, self.offset, len(data)))
            self.out.write(data)
            self.offset += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        bits = max(64, 8 * len(self.keys))
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[probes(k[:NAME], bits)] = True
        index, bloom = b"".join(self.index), struct.pack(">Q", bits) + np.packbits(bloom).tobytes()
        ends = self.offset, self.offset + len(index), self.offset + len(index) + len(bloom)
        self.out.write(index + bloom + FOOTER.pack(self.last, self.entries, self.ids, *ends, MAGIC))


class Reader:
    """One shard; reads the footer, index and filter at once and blocks when they are asked for."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.last, self.entries, self.ids, at, bloom, end, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self.blocks = list(BLOCK.iter_unpack(self.file.read_at(bloom - at, at)))
        (self.bits,) = struct.unpack(">Q", self.file.read_at(8, bloom))
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(end - bloom - 8, bloom + 8), np.uint8))

    def block(self, offset: int, length: int):
        data, at, key = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset)), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            yield key, data[at + rest : at + rest + size]
            at += rest + size

    def scan(self):
        for _, offset, length in self.blocks:
            yield from self.block(offset, length)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        key = key_of(doc_id)[:NAME]
        if not self.bloom[probes(key, self.bits)].all():
            return []
        out = []
        for i in range(max(0, bisect_right(self.blocks, key, key=lambda b: b[0][:NAME]) - 1), -1, -1):  # repeats may begin in an earlier block
            found = [np.frombuffer(v, "<u4") for k, v in self.block(*self.blocks[i][1:]) if k[:NAME] == key]
            out = found + out
            if self.blocks[i][0][:NAME] < key:
                break
        return out


def write(df: DataFrame, path: str, folder: str | None = None, end: int = 2, shards: int | None = None) -> DataFrame:
    """Encodes each whole text with the tokenizer file at `path`, appends id `end`, writes shards to `folder` (null: a new
    one in the shared folder) and returns one row for each: shard long, file, entries, ids. Shards are numbered in key order."""
    spark, folder = df.sparkSession, folder or scratch(df.sparkSession, "sstable")
    docs = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.crc32("text")).withColumn("shard", F.spark_partition_id().cast("long"))

    def run(batches):
        from pyspark import TaskContext

        fs, top = open_folder(folder)
        fs.create_dir(top, recursive=True)
        context = TaskContext.get()
        writer = name = None
        before, again = b"", 0
        for batch in pieces(batches):
            if writer is None:
                name = f"shard-{batch.column('shard')[0].as_py():06d}.sst"
                temporary = f"{top}/.{name}.{context.taskAttemptId()}"
                writer = Writer(fs.open_output_stream(temporary))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), library(path).ids(texts(batch.column("text"))), strict=True):
                key = key_of(doc_id)
                again = again + 1 if key == before else 0
                before = key
                writer.add(key_of(doc_id, again), np.append(ids, end).astype("<u4").tobytes())
        if writer:
            writer.close()
            writer.out.close()
            if fs.get_file_info(f"{top}/{name}").type != pafs.FileType.NotFound:  # of an attempt that was lost; some file systems don't move onto it
                fs.delete_file(f"{top}/{name}")
            fs.move(temporary, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(name[6:12])], pa.int64()), "file": [f"{folder.rstrip('/')}/{name}"], "entries": pa.array([writer.entries], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    return saved(as_arrow(ordered, run, "shard long, file string, entries long, ids long"), "sstable-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start long (ids of all documents before it in key order), ids array<int>, from the shards' files."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = open_folder(file)
                keys, starts, values, size = [], [], [], 0
                for key, value in Reader(fs, path).scan():
                    keys.append(id_of(key))
                    starts.append(start)
                    values.append(np.frombuffer(value, "<u4").astype(np.int32))
                    start, size = start + len(value) // 4, size + len(value)
                    if size > 1 << 21:
                        yield lists(keys, starts, values)
                        keys, starts, values, size = [], [], [], 0
                if keys:
                    yield lists(keys, starts, values)

    def lists(keys, starts, values):
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, np.concatenate(values))})

    located = files.withColumn("start", before)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return as_arrow(located.repartition(parts, "shard"), run, "doc_id long, start long, ids array<int>")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array(np.diff(at).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return as_arrow(df, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(files: list[str], doc_id: int | None) -> list[np.ndarray]:
    """The ids of one document, as often as it is stored. files: the shards in key order."""
    readers: dict[int, Reader] = {}

    def reader(i: int) -> Reader:
        if i not in readers:
            readers[i] = Reader(*open_folder(files[i]))
        return readers[i]

    i = bisect_left(range(len(files)), key_of(doc_id)[:NAME], key=lambda i: reader(i).last[:NAME])
    out = []
    while i < len(files) and (found := reader(i).get(doc_id)):  # repeats may go on in the next one
        out, i = out + found, i + 1
    return out
