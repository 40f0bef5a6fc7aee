"""Shared helpers: text columns as byte blocks, vectorised hashing, global ranks."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir as checkpoint_root

#: Fixed value: the white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Text handled at a time inside a task, so that numpy temporaries stay bounded.
BLOCK_BYTES = 2 << 20
#: Bytes of an Arrow batch that a task gets at a time.
ARROW_BYTES = 4 << 20

IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
#: Bytes that begin a code point.
IS_CHAR = (np.arange(256) & 0xC0) != 0x80

_ODD = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out)
    return have[:n]


class RangeHash:
    """64-bit hashes of any ranges [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.sums), pow(_ODD, -1, 1 << 64))
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(col: pa.Array | pa.ChunkedArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and n + 1 offsets; null is empty; ``end`` follows each text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = pc.fill_null(col, "")
    if end:
        col = pc.binary_join_element_wise(col, pa.scalar(end.decode(), pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer in which white space follows each text."""
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[1:] = ~IS_WHITE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes, since texts can be very long.

    A worker process serves many tasks of many stages: what a task has freed goes back to the system.
    """

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        _give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def _give_back() -> None:
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many leading underscores as keep them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    if len(keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """The same rows written as Parquet in the shared folder and read again: smaller than a checkpoint."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Rows numbered 0, 1, ... by ``order``: a range sort, then a count for each range.

    The only rows that meet in one task are one count per range. ``df`` should hold narrow rows and a
    unique order, so that a recomputed partition has the same rows in the same order.
    """
    parted = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parted.join(F.broadcast(counts), "_part").withColumn(name, F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")
