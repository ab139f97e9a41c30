"""What the operators of this subpackage share: tables written between steps, Arrow text slices and word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import shared_dir

#: ASCII white space, as in `[\x20\x09-\x0D]`.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text that one vectorised pass handles; a longer single text makes a pass of its own.
SLICE_BYTES = 1 << 21

U64 = np.uint64


# ------------------------------------------------------------------ tables between steps


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows up to which the written table of keys is sent to all executors; one row has some tens of bytes.
MAX_BROADCAST_ROWS = 500_000


def small_side(written: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A table of keys from materialize() for a join: broadcast if its counted rows are few, so that texts stay where they are; else joined by shuffle."""
    return F.broadcast(written) if written.count() <= most else written


def delete_path(spark: SparkSession, path: str) -> None:
    """Drops a folder that materialize() wrote, on whichever store it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def content_key(text) -> "F.Column":
    """Equal texts, equal keys (null counts as empty). 32 hex digits."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def extended(df: DataFrame, added: str) -> T.StructType:
    """The schema of df with the fields of a DDL string after its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


# ------------------------------------------------------------------ Arrow slices


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    if data is None or not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about `most` bytes of text at once, so that what a task holds does not grow with the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


# ------------------------------------------------------------------ words


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """256 flags: False for the bytes of the given inclusive spans, True for the others."""
    flags = np.ones(256, bool)
    for a, b in spans:
        flags[a : b + 1] = False
    return flags


#: `[^\x20\x09-\x0D]`
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed)) * U64(0x9E3779B97F4A7C15)) | U64(1)


_BYTES = stream(256, 7001)


def word_spans(data: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in data, and per text the index of its first word (one more at the end). Texts end words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    inside = word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of data: bytes times per-place multipliers, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    places = stream(int(lengths.max()), 9001)
    total = int(lengths.sum())
    with np.errstate(over="ignore"):
        heads = np.cumsum(lengths) - lengths
        rel = np.arange(total) - np.repeat(heads, lengths)
        values = _BYTES[data[np.repeat(starts, lengths) + rel]] * places[rel]
        return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
