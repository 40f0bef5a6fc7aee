"""Mixing sources to target weights by capped water-filling and seeded repetition.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the size of all documents. A
source's target stops at ``MAX_EPOCHS`` times its size; what is left over goes to the other sources by weight
until none is above. Each document is then taken a whole number of times, floor(target / source size), and the
documents that come first in a seeded hash order once more, until the source's target is met: the last of them
is taken in part. So a source's taken words equal its rounded target.

Null and empty texts have size 0 and are never taken. Rows that repeat a doc_id are put in order by their text; rows
that repeat both share a place, and where a source's last repetition ends among them, it goes through them one by one. An empty table gives an empty result. One source may hold any share of the rows: its hash order is dealt
over ``BUCKETS`` buckets, and only narrow rows (source, key, size) are shuffled, never text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import blocks, cut, global_rank, in_arrow, store, utf8, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = 20
#: A plan of at most this many sources is broadcast; a larger one is joined by key.
BROADCAST_SOURCES = 50_000


def word_counts(col: pa.Array) -> np.ndarray:
    if len(col) == 0:
        return np.zeros(0, np.int64)
    buf, off = utf8(col, end=b"\n")
    begin, _ = words(buf)
    return np.bincount(np.searchsorted(off, begin, side="right") - 1, minlength=len(col)).astype(np.int64)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, text_hash): words of each whole text, and what tells rows of one id apart."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), "text")

    def run(batches):
        for b in blocks(batches, "text"):
            cells = [b.column("doc_id"), b.column("source"), pa.array(word_counts(b.column("text"))), b.column("text_hash")]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "source", "size", "text_hash"])

    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, size long, text_hash long")


def _order_key(seed: int, doc_id, text_hash):
    h = F.xxhash64(F.lit(seed), doc_id)
    return F.struct(F.pmod(h, F.lit(BUCKETS)).alias("b"), h.alias("h"), doc_id.alias("d"), text_hash.alias("t"))


def _key(df: DataFrame, seed: int) -> DataFrame:
    return df.withColumn("_key", _order_key(seed, F.col("doc_id"), F.col("text_hash")))


def _numbered(rows: DataFrame, source: str, name: str) -> DataFrame:
    """Rows numbered 0, 1, ... within their source: by their place in written files, then a count for each task."""
    rows = store(rows, "boundary").withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    counts = rows.groupBy(source, "__task").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(source).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(source).alias("__of"), F.col("__task").alias("__in"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(source, "__task").orderBy("__row"))
    rows = rows.withColumn("__at", inside).join(counts, F.col(source).eqNullSafe(F.col("__of")) & (F.col("__task") == F.col("__in")))
    return rows.withColumn(name, F.col("__at") - 1 + F.col("__before")).drop("__task", "__row", "__at", "__of", "__in", "__before")


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_id, source_size, target) by water-filling; only scalars reach the driver."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = global_rank(per, F.col("source").asc_nulls_last(), name="source_id")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_id") % len(weights) + 1).cast("int"))
    per = cut(per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs))))
    total, level, capped = None, 0.0, -1
    while True:
        above = F.col("_w") * F.lit(level) > F.col("_cap") if total is not None else F.lit(False)
        got = per.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("_cap"))).alias("caps"),
            F.sum(F.when(~above, F.col("_w"))).alias("free"), F.count(F.when(above, 1)).alias("n"),
        ).first()
        total = float(got["total"] or 0)
        if got["n"] == capped or not got["free"]:
            break
        capped = got["n"]
        level = (total - (got["caps"] or 0.0)) / got["free"]
    return per.select("source", "source_id", "source_size", F.least(F.col("_w") * F.lit(level), F.col("_cap")).alias("target"))


def plan(sized: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: its target, whole repetitions, and where in the hash order the extra one ends."""
    per = targets(sized, weights, max_epochs).withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
    }).withColumn("extra", F.greatest(F.round("target").cast("long") - F.col("whole") * F.col("source_size"), F.lit(0).cast("long")))
    per = cut(per)
    small = per.count() <= BROADCAST_SOURCES
    near = F.broadcast(per) if small else per
    rows = _key(sized, seed).join(near.select(F.col("source").alias("_s"), "source_id", "extra"), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.select("source_id", "extra", "size", "_key", F.col("_key.b").alias("_b"))
    each = rows.groupBy("source_id", "_b").agg(F.sum("size").alias("_sum"))
    order = Window.partitionBy("source_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("source_id", "_b", "_sum", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_before"))
    # only the bucket in which a source's extra repetition ends has to be put in order
    ends = each.join(F.broadcast(per.select("source_id", "extra")) if small else per.select("source_id", "extra"), "source_id")
    ends = ends.where((F.col("_before") <= F.col("extra")) & (F.col("extra") < F.col("_before") + F.col("_sum"))).select("source_id", "_b", "_before")
    inside = rows.join(F.broadcast(ends) if small else ends, ["source_id", "_b"])
    inside = inside.groupBy("source_id", "_b", "_before", "extra", "_key").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source_id", "_b").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = inside.where((F.col("_at") <= F.col("extra")) & (F.col("extra") < F.col("_at") + F.col("size")))
    last = last.groupBy("source_id").agg(F.min(F.struct("_key", (F.col("extra") - F.col("_at")).alias("part"))).alias("_end"))
    return cut(per.join(last, "source_id", "left").select(
        F.col("source").alias("_s"), "source_size", "target", "whole", F.col("_end._key").alias("_end"), F.coalesce("_end.part", F.lit(0)).cast("long").alias("_part")))


def _placed(df: DataFrame, per: DataFrame, seed: int) -> DataFrame:
    """df with the plan's columns, joined on its source."""
    near = F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per
    return _key(df, seed).join(near, F.col("source").cast("string").eqNullSafe(F.col("_s")))


def taken(sized: DataFrame, per: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken)."""
    rows = _placed(sized, per, seed)
    at_end = F.coalesce(F.col("_key") == F.col("_end"), F.lit(False))
    extra = F.when(F.col("_key") < F.col("_end"), F.col("size")).otherwise(F.lit(0))
    ends = _numbered(rows.where(at_end).select("doc_id", "source", "size", "source_size", "target", "whole", "_part"), "source", "_nth")
    left = F.greatest(F.least(F.col("_part") - F.col("_nth") * F.col("size"), F.col("size")), F.lit(0))
    cols = lambda extra: ["doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken")]
    return rows.where(~at_end).select(*cols(extra)).unionByName(ends.select(*cols(left)))


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    buf = np.frombuffer(text.encode() + b"\n", np.uint8)
    _, end = words(buf)
    return "" if n <= 0 else text if n >= len(end) else text.encode()[: end[n - 1]].decode()


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is taken, the last repetition of a source cut to its words."""
    per = plan(cut(sizes(docs)), weights, max_epochs, seed)
    per = per.select("_s", "whole", "_end", "_part").toDF("__source", "__whole", "__end", "__part")
    near = F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per
    key = _order_key(seed, docs["doc_id"], F.xxhash64(docs["text"]))
    names, at = docs.columns, docs.columns.index("text")
    rows = docs.join(near, docs["source"].cast("string").eqNullSafe(near["__source"]))
    at_end = F.coalesce(key == F.col("__end"), F.lit(False))
    full = F.when(key < F.col("__end"), F.lit(1)).otherwise(F.lit(0))
    own = [docs[f"`{c}`"] for c in names]
    whole = rows.where(~at_end).select(*own, (F.col("__whole") + full).alias("__times"), F.lit(0).cast("long").alias("__words"))
    # rows with the key at which a source's extra repetition ends share what is left of it, one after the other
    ends = rows.where(at_end).select(*own, F.col("__whole").alias("__times"), F.col("__part"), F.col("__source").alias("__of_source"))
    ends = _numbered(ends, "__of_source", "__nth").select(*[f"`{c}`" for c in names], "__times", "__part", "__nth")

    def run(batches):
        for b in blocks(batches, "text"):
            own = b.select(names)
            size = word_counts(b.column("text"))
            times = b.column(len(names)).to_numpy().astype(np.int64) * (size > 0)
            part = b.column(len(names) + 1).to_numpy().astype(np.int64)
            if b.num_columns > len(names) + 2:
                part = np.clip(part - b.column(len(names) + 2).to_numpy() * size, 0, size)
                times += (part == size) & (size > 0)
                part = np.where(part == size, 0, part)
            yield own.take(pa.array(np.repeat(np.arange(len(times)), times)))
            some = np.flatnonzero(part)
            if len(some):
                own = own.take(pa.array(some))
                less = [first_words(t or "", int(n)) for t, n in zip(own.column(at).to_pylist(), part[some], strict=True)]
                yield own.set_column(at, own.schema.field(at), pa.array(less, own.schema.field(at).type))

    return in_arrow(whole, run, docs.schema).unionByName(in_arrow(ends, run, docs.schema))
