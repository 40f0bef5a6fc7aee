"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

A text's set holds its distinct word shingles (``SHINGLE`` words, A-Z lower-cased; with fewer words, all of
them as one). Texts with equal sets form a class, and one of each class goes on:

1. ``PERMS`` minima give ``PERMS / ROWS`` band keys; their lowest two bits are packed into three longs.
2. Classes that share a band key are candidates. The smallest class of a bucket is its head, and all classes
   that meet a head in some bucket are its group (about two groups a class). Groups are tasks with their
   members' full sets; large ones are dealt into blocks, a task for each pair of blocks.
3. In a task, bit counts of the packed signatures estimate the similarity, corrected for chance collisions of two
   bits; pairs clearly below the bound are left out (``SLACK`` below it, five standard errors). The full sets
   decide the others, unless the pair is connected already. Only links that connect something leave the task:
   fewer than members, whatever the group's size. So copies are never expanded into pairs, and no link between
   components that a shared band shows is lost.
4. Components by least label with pointer jumping.

With 24 bands of four rows a pair at the bound shares a band with probability 1 - 3e-6. Null ids are kept and
take part in no link; null texts and texts without a word have an empty set and no link. Rows that repeat an id
with the same text get the same result. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.bounded import small
from quarry.llm.common import BYTE_VALUE, RangeHash, blocks, cut, in_arrow, mix, utf8, words

SHINGLE = 5
SIMILARITY_PERCENT = 80
PERMS = 96
ROWS = 4
SLACK = 0.25
SEED = 11
#: A group of more members, or more bytes of sets, is dealt into blocks.
GROUP_ROWS = 2048
GROUP_BYTES = 16 << 20
#: Bytes of sets that a task copies or compares at a time.
PIECE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIG = ("s0", "s1", "s2")


def shingles(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, sorted within each, and n + 1 offsets."""
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    buf, off = utf8(col, end=b"\n")
    buf = LOWER[buf]
    w0, w1 = words(buf)
    text = np.searchsorted(off, w0, side="right") - 1
    ranges = RangeHash(RangeHash(BYTE_VALUE[buf])(w0, w1))
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    start = np.flatnonzero(np.arange(len(w0)) - first[text] + k <= count[text])
    short = np.flatnonzero((count > 0) & (count < k))
    begin = np.concatenate((start, first[short]))
    end = np.concatenate((start + k, first[short] + count[short]))
    of = np.concatenate((text[start], short))
    h = ranges(begin, end)
    order = np.argsort(h)
    order = order[np.argsort(of[order], kind="stable")]
    h, of = h[order], of[order]
    stay = np.ones(len(h), bool)
    stay[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[stay], of[stay]
    return h, np.searchsorted(of, np.arange(n + 1))


def _minima(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out, v = np.empty((PERMS, len(starts)), np.uint64), np.empty_like(h)
    for i in range(PERMS):
        np.bitwise_xor(h, _XOR[i], out=v)
        np.multiply(v, _MUL[i], out=v)
        out[i] = np.minimum.reduceat(v, starts)
    return out


def sketch(col: pa.Array, k: int = SHINGLE) -> dict[str, np.ndarray | pa.Array]:
    """Set size, two checksums of the set, three longs of two bits a minimum, and the band keys."""
    h, off = shingles(col, k)
    size = np.diff(off)
    full = np.flatnonzero(size)
    out = {c: np.zeros(len(size), np.uint64) for c in ("set1", "set2", *_SIG)}
    bands = PERMS // ROWS
    keys = np.zeros((0, bands), np.uint64)
    if len(full):
        starts = off[full]
        out["set1"][full] = np.add.reduceat(h, starts)
        out["set2"][full] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
        low = mix(least := _minima(h, starts))
        for j, name in enumerate(_SIG):
            for i in range(32):
                out[name][full] |= (low[32 * j + i] & np.uint64(3)) << np.uint64(2 * i)
        keys = np.empty((len(full), bands), np.uint64)
        for b in range(bands):
            key = np.full(len(full), b + 1, np.uint64)
            for i in range(ROWS):
                key = mix(key * np.uint64(0x9FB21C651E98DF25) + least[ROWS * b + i])
            keys[:, b] = key
    have = np.zeros(len(size) + 1, np.int32)
    have[1:] = np.cumsum(np.where(size > 0, bands, 0))
    return {"n_shingles": size.astype(np.int64), **{c: v.view(np.int64) for c, v in out.items()}, "keys": pa.ListArray.from_arrays(pa.array(have), pa.array(keys.ravel().view(np.int64)))}


def text_digest():
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, digest of the text, and its ``sketch``."""
    cols = ["n_shingles", "set1", "set2", *_SIG, "keys"]

    def run(batches):
        for b in blocks(batches, "text"):
            got = sketch(b.column("text"), k)
            cells = [got[c] if c == "keys" else pa.array(got[c]) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), *cells], names=["doc_id", "digest", *cols])

    rows = docs.select("doc_id", "text", text_digest().alias("digest"))
    kinds = ", ".join(f"{c} {'array<long>' if c == 'keys' else 'long'}" for c in cols)
    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, {kinds}")


def portions(sizes: np.ndarray, limit: int):
    """Ranges [a, b) of rows whose sizes sum up to ``limit`` at most, one row at least."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def _enough(percent: int) -> int:
    """Equal two-bit minima from which a pair is not clearly below the bound; two bits agree by chance in a quarter."""
    return int(np.floor(PERMS * (max(percent / 100 - SLACK, 0.0) * 0.75 + 0.25)))


def links_of_group(n: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the members of a group as all its links would; members come with the head first.

    Bit counts of the packed minima pick the pairs worth a look; the full sets decide. Pairs that are connected
    already are passed over. ``side``: 0 for the head, else the member's block; where there are two blocks, pairs
    within a block are another task's.
    """
    m = len(n)
    comp, out = np.arange(m), []
    enough, two = _enough(percent), len(set(side[1:].tolist())) > 1
    low = np.uint64(0x5555555555555555)
    for x in range(m - 1):
        rest = slice(x + 1, m)
        try_ = (comp[rest] != comp[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))
        if two and side[x]:
            try_ &= side[rest] != side[x]
        if not try_.any():
            continue
        y = x + 1 + np.flatnonzero(try_)
        d = sig[y] ^ sig[x]
        differ = np.bitwise_count((d | (d >> np.uint64(1))) & low).sum(axis=1)
        y = y[PERMS - differ.astype(np.int64) >= enough]
        if not len(y):
            continue
        for a, b in portions(8 * n[y], PIECE_BYTES):
            z = y[a:b]
            flat = np.concatenate([sets[k] for k in z])
            at = np.searchsorted(sets[x], flat)
            same = sets[x][np.minimum(at, len(sets[x]) - 1)] == flat
            both = np.add.reduceat(same.astype(np.int64), np.cumsum(n[z]) - n[z])
            for k in z[100 * both >= percent * (n[x] + n[z] - both)].tolist():
                if comp[k] != comp[x]:
                    comp[comp == comp[k]] = comp[x]
                    out.append((x, k))
    return out


_MEMBER = "g long, lo int, hi int, side int, id long, n long, s0 long, s1 long, s2 long, hashes binary"


def _members(docs: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """A row with the full set for each task that a class takes part in.

    The classes that met a head in some bucket are its group. Groups above ``GROUP_ROWS`` rows or ``GROUP_BYTES``
    of sets are dealt into blocks, and each pair of blocks is a task of its own, with the head in all of them.
    """
    group = met.select(F.col("h").alias("g"), "id", "n", *_SIG)
    size = group.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks_ = F.ceil(F.greatest(F.col("m") / GROUP_ROWS, F.col("total") * 8 / GROUP_BYTES)).cast("int")
    large = cut(size.select("g", blocks_.alias("nb")).where("nb > 1"))
    group = group.join(small(large), "g", "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int") + 1)
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.col("nb")), lambda a: F.transform(F.sequence(a, F.col("nb")), lambda b: F.struct(a.alias("lo"), b.alias("hi"), F.lit(0).alias("side")))))
    mine = F.transform(F.sequence(F.lit(1), F.col("nb")), lambda a: F.struct(F.least(a, F.col("blk")).alias("lo"), F.greatest(a, F.col("blk")).alias("hi"), F.col("blk").alias("side")))
    tasks = group.withColumn("t", F.explode(F.when(F.col("g") == F.col("id"), every).otherwise(mine)))
    asked = tasks.groupBy("id").agg(F.collect_list(F.struct("g", "t.lo", "t.hi", "t.side", "n", *_SIG)).alias("tasks"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(asked, "id")

    def run(batches):
        names = ["g", "lo", "hi", "side", "n", *_SIG]
        for b in blocks(batches, "text"):
            h, off = shingles(b.column("text"), k)
            tasks = b.column("tasks")
            row = np.repeat(np.arange(b.num_rows), np.diff(tasks.offsets.to_numpy()))
            flat = tasks.flatten()
            size = np.diff(off)
            at = np.flatnonzero(size[row] == flat.field("n").to_numpy())  # of rows that share an id, the ones with this set
            for lo, hi in portions(8 * size[row[at]], PIECE_BYTES):
                mine, of = at[lo:hi], row[at[lo:hi]]
                end = np.zeros(len(of) + 1, np.int64)
                np.cumsum(size[of], out=end[1:])
                sets = h[np.arange(end[-1]) + np.repeat(off[of] - end[:-1], size[of])]
                data = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((8 * end).astype(np.int32)), pa.py_buffer(sets)])
                cols = {c: flat.field(c).take(pa.array(mine)) for c in names} | {"id": b.column("id").take(pa.array(of)), "hashes": data}
                yield pa.RecordBatch.from_arrays([cols[c.split()[0]] for c in _MEMBER.split(", ")], names=[c.split()[0] for c in _MEMBER.split(", ")])

    return in_arrow(rows.select("id", "text", "tasks"), run, _MEMBER)


def _links(percent: int):
    def judge(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        c = {k: t[k].to_numpy() for k in ("side", "id", "n", *_SIG)}
        order = np.lexsort((c["id"], c["side"] != 0))
        keep = np.concatenate(([True], c["id"][order][1:] != c["id"][order][:-1]))  # repeated rows once
        order = order[keep]
        c = {k: v[order] for k, v in c.items()}
        col = t["hashes"].chunk(0)  # a task's sets stay below 2 GB
        _, offsets, data = col.buffers()
        end = np.frombuffer(offsets, np.int32)[col.offset : col.offset + t.num_rows + 1]
        raw = np.frombuffer(data, np.uint8)
        sets = [raw[end[i] : end[i + 1]].view(np.uint64) for i in order.tolist()]
        sig = np.stack([c[k].view(np.uint64) for k in _SIG], axis=1)
        pairs = links_of_group(c["n"], sig, sets, c["side"], percent)
        a, b = (c["id"][[p[i] for p in pairs]] if pairs else np.zeros(0, np.int64) for i in (0, 1))
        return np.minimum(a, b), np.maximum(a, b)

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], names=["a", "b"])

    def run(batches):
        held, last = [], None
        for b in batches:
            if b.num_rows == 0:
                continue
            found = []
            key = np.stack([b.column(k).to_numpy() for k in ("g", "lo", "hi")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if held and tuple(key[0]) != last:
                found.append(judge(held))
                held = []
            at = 0
            for e in cuts.tolist():
                found.append(judge([*held, b.slice(at, e - at)]))
                held, at = [], e
            held.append(b.slice(at))
            last = tuple(key[-1])
            if found:
                yield rows(found)
        if held:
            yield rows([judge(held)])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of the edges (a, b) reaches."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "b", "c": "m"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("m").alias("m"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        over = step.select(F.col("v").alias("c"), F.col("c").alias("m"))
        after = cut(step.join(over, "c").select("v", "old", F.least("c", "m").alias("c")))
        if after.where(F.col("c") != F.col("old")).isEmpty():
            return labels
        labels = after.select("v", "c")


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept), a row for each row of ``docs``."""
    sig = cut(signatures(docs, k))
    same = ["n_shingles", "set1", "set2"]
    full = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = cut(full.groupBy(*same).agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in (*_SIG, "keys")]))
    spread = classes.select(F.explode("keys").alias("key"), "id", F.col("n_shingles").alias("n"), *_SIG)
    heads = spread.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("h")).where("m > 1")
    met = cut(spread.join(heads.select("key", "h"), "key").drop("key").distinct())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _members(docs, met, k).repartition(parts, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    labels = components(in_arrow(members, _links(percent), "a long, b long").distinct())

    member = sig.select("doc_id", "digest", "n_shingles", "set1", "set2").join(classes.select(*same, F.col("id")), same, "left")
    rows = member.join(labels, F.col("id") == F.col("v"), "left")
    component = F.coalesce("c", "id", "doc_id")
    return rows.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def link(docs: DataFrame, k: int = SHINGLE, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    return _linked(docs, k, percent).drop("digest")


def first_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies of a smaller doc_id's group; of rows that share an id only those go
    whose own text is such a copy."""
    out = _linked(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return docs.join(out, (docs["doc_id"] == F.col("__id")) & (text_digest() == F.col("__digest")), "left_anti")
