"""Sharding by longest processing time: whole groups, largest first, each to the least-loaded shard.

Rows with equal texts are a group and stay together (null counts as the empty text). Sizes are UTF-8 bytes plus
``ROW_BYTES``. A heap holds the shards by load (ties: the smaller number). Groups of one size differ in nothing
the heap sees, so it is fed with the histogram of group sizes, in descending order: one class per distinct size,
whole rounds of a class by arithmetic and its last groups by pops. The loads are those of the plain algorithm over
all groups. D distinct sizes need at least D * D / 2 bytes of input, so the histogram that the driver gets is
below sqrt(2 * bytes) rows: 14 million at 100 TB, and far fewer where sizes repeat.

Groups are numbered inside their class by a range sort, and the class says which numbers go to which shard. A group
that holds over 1 / ``HOT_SHARE`` of the rows meets its shard by a broadcast of at most ``HOT_SHARE`` rows, the others by
a shuffle. Slots are ranks of (shard, doc_id, digest) by ranges, so no task gets a shard as a whole.

One group may be larger than a shard's even share; it still stays together, and the other shards share the rest.
Null ids are kept and come first in their shard; rows that repeat an id are rows of their own; an empty table
gives no rows. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.bounded import small
from quarry.llm.common import global_rank, store

SHARDS = 40
ROW_BYTES = 16
#: A group above this share of all rows is joined by a broadcast.
HOT_SHARE = 4096


def _whole_rounds(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each shard surely gets: those that end up below a common level."""

    def below(level: int) -> list[int]:
        return [max(0, -(-(level - load) // size)) for load in loads]

    low, high = min(loads), max(loads) + size * (count // len(loads) + 1)
    while low < high:
        mid = (low + high + 1) // 2
        if sum(below(mid)) <= count:
            low = mid
        else:
            high = mid - 1
    return below(low)


def schedule(classes: Iterable[tuple[int, int]], shards: int = SHARDS) -> tuple[list[tuple[int, int, list[int], list[int]]], list[int]]:
    """Shards of every class of equal groups, given as (size, count) by descending size, and the final loads.

    A class becomes (size, groups before it, ends, shards): its groups from the last end up to ``ends[k]``
    go to ``shards[k]``.
    """
    heap = [(0, shard) for shard in range(shards)]
    out, before = [], 0
    for size, count in classes:
        taken: dict[int, int] = {}
        rest = count
        if count > 2 * shards:
            loads = [0] * shards
            for load, shard in heap:
                loads[shard] = load
            rounds = _whole_rounds(loads, size, count)
            taken = {shard: n for shard, n in enumerate(rounds) if n}
            rest = count - sum(rounds)
            heap = [(load + size * rounds[shard], shard) for shard, load in enumerate(loads)]
            heapq.heapify(heap)
        for _ in range(rest):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            taken[shard] = taken.get(shard, 0) + 1
        picked = sorted(taken)
        out.append((size, before, np.cumsum([taken[s] for s in picked]).tolist(), picked))
        before += count
    loads = [0] * shards
    for load, shard in heap:
        loads[shard] = load
    return out, loads


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def group_shards(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(digest, n, shard) of every group of equal texts."""
    spark = rows.sparkSession
    groups = store(rows.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "groups")
    classes = groups.groupBy("bytes").agg(F.count("*").alias("groups")).toArrow()
    sizes, counts = (classes.column(c).to_numpy() for c in ("bytes", "groups"))
    order = np.argsort(-sizes, kind="stable")
    plan, _ = schedule(zip(sizes[order].tolist(), counts[order].tolist()), shards)
    names = ("bytes", "before", "ends", "shards")
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    columns = [pa.array(c, t) for c, t in zip(zip(*plan) if plan else ([], [], [], []), kinds)]
    planned = spark.createDataFrame(pa.table(columns, names=names))
    ranked = global_rank(groups, F.col("bytes").desc(), "digest")
    place = F.col("rank") - F.col("before")
    shard = F.element_at("shards", (F.size(F.filter("ends", lambda e: e <= place)) + 1).cast("int"))
    return ranked.join(small(planned), "bytes").select("digest", "n", shard.alias("shard"))


def with_shard(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows with the shard of their group; a hot group never meets in one task."""
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(groups.where(is_hot).select("digest", "shard"))
    cold = groups.where(~is_hot).select("digest", "shard")
    return rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    rows = store(sized(docs), "sized")
    groups = store(group_shards(rows, shards), "group-shards")
    placed = global_rank(with_shard(rows, groups, rows.count()), "shard", F.col("doc_id").asc_nulls_first(), "digest")
    placed = store(placed, "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # a row per shard
    return placed.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write(docs: DataFrame, folder: str, shards: int = SHARDS, file_bytes: int = 256 << 20) -> None:
    """Whole rows of ``docs`` as Parquet, a folder ``shard=K`` per shard, in files of about ``file_bytes``.

    ``docs`` has no columns named digest, shard or _file; ValueError otherwise.
    """
    clash = {"digest", "shard", "_file"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are needed for the shards")
    rows = store(sized(docs), "sized")
    groups = store(group_shards(rows, shards), "group-shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("digest", F.unhex(F.sha2(text.cast("binary"), 256)))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    files = max(1, -(-int(total.b) // (shards * file_bytes)))
    out = with_shard(keyed, groups, total.n).drop("digest").withColumn("_file", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files)))
    out.repartition(shards * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(folder)
