"""Shared storage, text buffers and hashing for the operators of this subpackage.

Text reaches Python as Arrow string columns, whose UTF-8 bytes and offsets numpy views
without copying. All functions here work on bounded slices of such a column, so memory
follows the slice and not the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.skew import BROADCAST_ROWS, broadcast_small, salted_join
from corpusloom.operators.storage import discard, release
from corpusloom.operators.storage import materialized as stored
from corpusloom.workers import importable

#: Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bounds of an Arrow batch of texts. A longer text is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


#: Bytes of input, as Spark estimates them, for each partition of an exchange that a task holds in memory.
PARTITION_BYTES = 64 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(df: DataFrame) -> int:
    """As many partitions as the session's setting, or more for a large input (whose size in bytes Spark may not know)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = shuffle_partitions(df.sparkSession)
    return least if size >= 1 << 60 else max(least, -(-size // PARTITION_BYTES))


def plain(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text alone: further columns, whatever their names, stay out of the plan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that long texts don't pile up in one, and let workers import this package.

    Plans are lazy and read these settings when they run, so the session keeps them; tighter ones that it has stay.
    """
    importable(spark)
    for name, bound in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have up to limit bytes, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def doc_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and validity of an id column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), valid


# ---------------------------------------------------------------- hashing

#: Longest span, in bytes, that is hashed beside others, 8 bytes at a time.
_BESIDE = 128
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash_pairs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the bytes start to end of each span, equal for equal bytes wherever they stand.

    Both take in 8 bytes at a time and mix all bits after each, so that no structure of the text (mirrored, alternating or
    repeated letters) carries over to the hashes. Long spans are hashed one by one.
    """
    wide = np.zeros(len(raw) + 8, np.uint8)
    wide[: len(raw)] = raw
    lanes = np.ndarray((len(raw) + 1,), "<u8", wide.data, 0, (1,))
    size = ends - starts
    a = mix(size.astype(np.uint64) + _ODD[0] + np.uint64(seed))
    b = mix(size.astype(np.uint64) ^ _ODD[1]) + np.uint64(seed)
    long = np.flatnonzero(size > _BESIDE)
    live = np.flatnonzero((size > 0) & (size <= _BESIDE))
    done = 0
    while len(live):
        lane = lanes[starts[live] + done] & _LOW_BYTES[np.minimum(size[live] - done, 8)]
        a[live] = mix(a[live] ^ (lane * _ODD[2]))
        b[live] = mix((b[live] + lane) * _ODD[3])
        done += 8
        live = live[size[live] > done]
    if len(long):
        data, salt = memoryview(np.ascontiguousarray(raw)), seed.to_bytes(8, "little")
        found = b"".join(hashlib.blake2b(data[x:y], digest_size=16, salt=salt).digest() for x, y in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        a[long], b[long] = np.frombuffer(found, "<u8").reshape(-1, 2).T
    return a, b


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from both of span_hash_pairs."""
    a, b = span_hash_pairs(raw, starts, ends)
    return mix(a + (b << np.uint64(32) | b >> np.uint64(32)))


# ---------------------------------------------------------------- words

#: The bytes that end a word, \x20 and \x09 to \x0D.
WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def spans_of(breaks: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no breaks, and the first run of each row (n + 1 values).

    A run ends with its row.
    """
    n = len(raw)
    inside = ~breaks[raw]
    first = inside.copy()
    last = inside.copy()
    if n > 1:
        joined = inside[1:] & inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < n)] - 1
        joined[cuts] = False
        first[1:] &= ~joined
        last[:-1] &= ~joined
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans_of(WORD_BREAKS, raw, offsets)
