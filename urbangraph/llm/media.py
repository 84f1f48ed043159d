"""Media columns: payloads stored as progressive JPEG files in a binary column, and what is read back from them.

Defined results: a null payload counts as empty text and becomes 192 spaces; rows are independent, so repeated rows and
null identifiers keep their rows; an empty table gives an empty table; columns other than those in `keep` are not read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbangraph.llm import jpeg
from urbangraph.llm.arrays import as_arrow, pieces, scratch

UNIT = 192


def types(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def padded(text: bytes) -> bytes:
    """With spaces up to a positive multiple of UNIT."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes long (UTF-8, before padding), media binary (a JPEG file)."""

    def run(batches):
        for batch in pieces(batches):
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(map(len, raw), pa.int64()), pa.array([jpeg.encode(padded(x)) for x in raw], pa.binary())], [*keep, "n_bytes", "media"])

    return as_arrow(df.select(*keep, F.col(text).alias("text")), run, types(df, keep) + "n_bytes long, media binary")


def feature(rgb) -> str:
    """Height x width, mean of each channel and a checksum of the tensor."""
    h, w, _ = rgb.shape
    return f"{h}x{w}:{','.join(f'{x / (h * w):.3f}' for x in rgb.sum((0, 1), dtype='int64').tolist())}:{zlib.crc32(rgb.tobytes()):08x}"


def load(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), tensor: bool = True) -> DataFrame:
    """`keep`, media, payload binary (as stored), height int, width int, feature string and, if asked for, tensor binary (RGB, row by row)."""

    def run(batches):
        for batch in pieces(batches, "media"):
            images = [jpeg.Image(x) for x in batch.column("media").to_pylist()]
            shown = [x.rgb() for x in images]
            columns = {c: batch.column(c) for c in (*keep, "media")}
            columns |= {"payload": pa.array([x.payload() for x in images], pa.binary()), "height": pa.array([x.height for x in images], pa.int32()), "width": pa.array([x.width for x in images], pa.int32()), "feature": pa.array(map(feature, shown), pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"tensor": pa.array([x.tobytes() for x in shown], pa.binary())} if tensor else {}))

    return as_arrow(df.select(*keep, "media"), run, types(df, keep) + "media binary, payload binary, height int, width int, feature string" + ", tensor binary" * tensor)


def tensors(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows written to `folder` (null: a new one in the shared folder) and read from there; row groups are small, as a row may be long."""
    folder = folder or scratch(df.sparkSession, "tensors")
    df.write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20}).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_digests(df: DataFrame, folder: str | None = None) -> DataFrame:
    """`digests` of `load`'s rows, whose tensors are stored beside them; the feature's checksum is that of the stored tensor."""
    kept = tensors(digests(df, "tensor"), folder)
    checksum = F.lpad(F.lower(F.hex(F.crc32("tensor"))), 8, "0")
    return kept.withColumn("feature", F.concat_ws(":", F.substring_index("feature", ":", 2), checksum)).drop("tensor")


def digests(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        *more,
    )
