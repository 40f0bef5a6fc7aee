"""Which strings occur in which texts, by an inverted index over grams.

A gram is eight bytes as one long (a shorter string is its own gram, with its size). One scan of the texts gives a
posting (text, gram) for every gram that some string has; a bitmap of fixed size tells the scan which grams those are,
so it costs the same for ten strings and for a billion. Of its grams each string takes the one that fewest texts have,
and meets the postings by an equi-join on it. Only strings of more than eight bytes have to be looked for in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.bounded import small
from quarry.session import stored

#: Bytes of a gram.
WIDTH = 8
#: Bits of the bitmap of grams (8 MB) and of that of their first bytes, whatever the number of strings.
BITMAP_BITS = 26
FIRST_BITS = 22
#: First bytes of a gram by which most places of a text are passed over.
FIRST = 4
#: Text looked at in one go inside a task.
BLOCK_BYTES = 1 << 20

_PAD = "\0" * WIDTH


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _windows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eight bytes from every place of the texts on as a number, and start and length of each text; null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    size = pc.binary_length(col).to_numpy().astype(np.int64)
    joined = pc.binary_join_element_wise(col, pa.scalar(_PAD, pa.large_string()), pa.scalar("", pa.large_string()))
    raw = _bytes(joined)
    start = np.cumsum(size + WIDTH) - (size + WIDTH)
    return np.ndarray((max(0, len(raw) - WIDTH + 1),), "<u8", raw, strides=(1,)), start, size


def _bytes(col: pa.Array) -> bytes:
    if len(col) == 0:
        return b""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)
    return data.to_pybytes()[at[col.offset] : at[col.offset + len(col)]]


def _gram(window: np.ndarray, size: int) -> np.ndarray:
    return window if size == WIDTH else window & np.uint64((1 << (8 * size)) - 1)


def _slot(gram: np.ndarray, size: np.ndarray | int, scope: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(gram + np.asarray(size, np.uint64)) + scope) >> np.uint64(64 - bits)


def _first_slot(first: np.ndarray, bits: int) -> np.ndarray:
    return (first * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def _string_grams(bits: int, first_bits: int):
    """A task function: (string, scope) -> (string, scope, size, gram, slot, first) for each gram of a string."""

    def run(batches):
        for b in batches:
            window, start, length = _windows(b.column(0))
            size = np.minimum(length, WIDTH)
            count = np.where(length > 0, length - size + 1, 0)
            row = np.repeat(np.arange(len(count)), count)
            at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            gram = window[at].copy()
            for s in range(1, WIDTH):
                some = size[row] == s
                gram[some] = _gram(gram[some], s)
            scope = b.column(1).to_numpy().view(np.uint64)[row]
            slot = _slot(gram, size[row], scope, bits)
            take = pa.array(row)
            cols = [b.column(0).take(take), b.column(1).take(take), pa.array(size[row].astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(slot.astype(np.int64))]
            cols.append(pa.array(_first_slot(gram.astype(np.uint32), first_bits).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(cols, names=["string", "scope", "size", "gram", "slot", "first"])

    return run


def _blocks(batches, limit: int):
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
            yield b.slice(at, stop - at)
            at = stop


def _scan(tables, sizes: list[int], keys: list[str], width: int, first_width: int, limit: int):
    """A task function: texts -> (keys, scope, size, gram) for each gram of the bitmap that a text has."""

    def run(batches):
        bits, first = tables.value
        for b in _blocks(batches, limit):
            window, start, length = _windows(b.column("text"))
            scope = b.column("scope").to_numpy().view(np.uint64)
            row_of = np.repeat(np.arange(len(start), dtype=np.int32), length + WIDTH)[: len(window)]
            some = None
            if max(sizes, default=0) >= FIRST and len(window):
                lead = np.ndarray((len(window),), "<u4", window.base, strides=(1,))
                some = np.flatnonzero(first[_first_slot(lead, first_width)])
            for size in sizes:
                at = some if size >= FIRST else np.arange(len(window))
                gram, row = _gram(window[at], size), row_of[at]
                slot = _slot(gram, size, scope[row], width)
                hit = np.flatnonzero(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
                row, gram = row[hit], gram[hit]
                order = np.argsort(gram)
                row, gram = row[order], gram[order]
                order = np.argsort(row, kind="stable")
                row, gram = row[order], gram[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                row, gram = row[new], gram[new]
                own = [b.column(k).take(pa.array(row)) for k in (*keys, "scope")]
                cols = [*own, pa.array(np.full(len(row), size, np.int32)), pa.array(gram.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "scope", "size", "gram"])

    return run


def _bitmap(slots: DataFrame, slot: str, bits: int) -> np.ndarray:
    """The slots as words of 64 bits: at most 2 ** (bits - 6) rows reach the driver."""
    words = slots.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({slot} & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def occurrences(texts: DataFrame, strings: DataFrame, keys: list[str], scoped: bool = False, confirm: bool = True) -> DataFrame:
    """(keys, string): the strings that a text holds; with ``scoped`` only those of its own scope.

    ``texts`` has the keys, ``text`` and, if scoped, ``scope``; ``strings`` has ``string`` and, if scoped, ``scope``.
    Without ``confirm`` the pairs are those that share the string's rarest gram. Empty strings occur nowhere. Texts with
    the same keys each give their pairs.
    """
    spark = texts.sparkSession
    scope = F.xxhash64("scope") if scoped else F.lit(0).cast("long")
    wanted = strings.select("string", scope.alias("scope")).distinct()
    found = wanted.mapInArrow(_string_grams(BITMAP_BITS, FIRST_BITS), "string string, scope long, size int, gram long, slot long, first long")
    grams = stored(found, "string-grams")
    bits = _bitmap(grams, "slot", BITMAP_BITS)
    first = _bitmap(grams.where(F.col("size") >= FIRST), "first", FIRST_BITS)
    first = np.unpackbits(first.view(np.uint8), bitorder="little").astype(bool)
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most WIDTH
    side = texts.select(*keys, "text", scope.alias("scope"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in side.schema.fields if f.name not in ("text", "scope"))
    scan = _scan(spark.sparkContext.broadcast((bits, first)), sizes, keys, BITMAP_BITS, FIRST_BITS, BLOCK_BYTES)
    seen = stored(side.mapInArrow(scan, f"{kinds}, scope long, size int, gram long"), "postings")
    by = ["scope", "size", "gram"]
    number = seen.groupBy(*by).agg(F.count("*").alias("n"))
    rarest = grams.join(number, by).groupBy("string", "scope").agg(F.min(F.struct("n", "size", "gram")).alias("r"))
    rarest = stored(rarest.select("string", "scope", "r.size", "r.gram"), "rarest-grams")
    hits = seen.join(small(rarest), by).select(*keys, "string", "scope")
    if not confirm:
        return hits.select(*keys, "string")
    sure = (F.octet_length("string") <= WIDTH) & ~F.contains("string", F.lit("\0"))
    asked = stored(hits.where(~sure).groupBy(*keys, "scope").agg(F.collect_set("string").alias("asked")), "unsure")
    found = side.join(small(asked), [*keys, "scope"]).select(*keys, F.explode(F.filter("asked", lambda s: F.contains("text", s))).alias("string"))
    return hits.where(sure).select(*keys, "string").unionByName(found)
