"""Removal of repeated passages by longest-previous-factor arrays over a distributed suffix order.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller doc_id,
or earlier in the same one. Strings are judged on the input and never cross documents.

1. Anchors. Of the ``LENGTH - GRAM + 1`` grams in a window, the one of least hash (the leftmost of equals) is its
   anchor, so equal windows have equal anchors. Windows in a row with one anchor form a run (about 35 windows);
   a run is shuffled as one row: anchor hash, hash of the run's bytes, place. Inside a run no two windows are equal.
2. Runs with equal bytes: all but the first are repeated and go. If an anchor has runs of one kind only, its
   first run has no earlier match. What is left are the first runs of anchors with several kinds: the edges of
   repeated passages.
3. For these, all window starts are put in suffix order within their anchor's block, the longest common prefixes
   of neighbours are taken (up to ``LENGTH``), and the previous and next smaller positions in suffix order give
   each suffix its longest previous factor. Where that reaches ``LENGTH``, the window goes.
4. Each document's windows are united and cut out.

Hot anchors: a task sends equal runs of its own rows no further than the first; an anchor with many kinds in one
task is salted by the run's hash (a marker tells its home partition), and anchors with more than ``HOT_RUNS``
kinds are put in order by single windows, each under its own hash. Sorting and grouping run over streams of
sorted rows, so no group has to fit in memory.

Null texts are empty. A null doc_id has no place in the order: such rows keep their text. Rows that repeat an id
and text are one document, and each gets the result. Texts shorter than ``LENGTH`` bytes stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.bounded import small
from quarry.llm.common import BYTE_VALUE, RangeHash, blocks, cut, fresh_names, in_arrow, mix, run_starts, store, utf8

LENGTH = 100
GRAM = 32
#: Text whose runs a task compares before it sends them on.
LOCAL_BYTES = 8 << 20
#: Kinds of runs of one anchor, in one task's rows, from which they are salted.
SALT_RUNS = 32
#: Kinds of runs of one anchor from which they are ordered window by window.
HOT_RUNS = 512
#: Bytes of runs put in suffix order at a time.
ORDER_BYTES = 1 << 20
#: Text whose windows are looked at in one go.
PART_BYTES = 1 << 20

_PLACE = np.uint64((1 << 24) - 1)
ASK, DONE, SALTED, MARK = 0, 1, 2, 3
_RUN_SCHEMA = "bucket long, anchor long, kind long, doc long, loc long, n long, state byte"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    n = len(x) - width + 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def runs(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of the texts of a buffer: anchor and content hash, text, place in the text, windows."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "loc", "n")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "kind")}
    n = len(buf) - LENGTH + 1
    long = np.flatnonzero(np.diff(off) >= LENGTH)
    if n <= 0 or not len(long):
        return none
    ranges = RangeHash(BYTE_VALUE[buf])
    at = np.arange(len(buf) - GRAM + 1)
    grams = ranges(at, at + GRAM)
    least = sliding_min((grams & ~_PLACE) | at.astype(np.uint64), LENGTH - GRAM + 1)
    place = (least & _PLACE).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, off[long], 1)
    np.add.at(inside, np.minimum(off[long + 1] - LENGTH + 1, n), -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    text = np.searchsorted(off, start, side="right") - 1
    return {"anchor": grams[place[start]], "kind": ranges(start, end - 1 + LENGTH), "text": text, "loc": start - off[text], "n": end - start}


def _pieces(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffer, offsets, row and start of each text; very long texts come in parts that overlap by a window."""
    part = PART_BYTES
    buf, off = utf8(col)
    if len(buf) <= part:
        yield buf, off, np.arange(len(off) - 1), np.zeros(len(off) - 1, np.int64)
        return
    for i in range(len(off) - 1):
        for s in range(int(off[i]), int(off[i + 1]), part):
            b = buf[s : min(s + part + LENGTH - 1, int(off[i + 1]))]
            yield b, np.array([0, len(b)]), np.array([i]), np.array([s - off[i]])


def _local(rows: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    """One task's runs: equal ones settled, anchors of many kinds salted."""
    r = {k: np.concatenate([x[k] for x in rows]) for k in rows[0]}
    order = np.lexsort((r["loc"], r["doc"], r["kind"], r["anchor"]))
    r = {k: v[order] for k, v in r.items()}
    new_anchor = np.zeros(len(order), bool)
    new_anchor[run_starts(r["anchor"])] = True
    new_kind = new_anchor.copy()
    new_kind[1:] |= r["kind"][1:] != r["kind"][:-1]
    head = np.maximum.accumulate(np.where(new_kind, np.arange(len(order)), 0))
    again = ~new_kind & ((r["doc"] != r["doc"][head]) | (r["loc"] != r["loc"][head]))
    group = np.cumsum(new_anchor) - 1
    salted = (np.bincount(group, new_kind) >= SALT_RUNS)[group] if len(group) else np.zeros(0, bool)
    state = np.where(again, DONE, np.where(salted, SALTED, ASK))
    stay = new_kind | again
    bucket = np.where(again, mix(r["doc"].astype(np.uint64) + r["kind"]), np.where(salted, mix(r["anchor"] + r["kind"]), r["anchor"]))
    marks = np.flatnonzero(new_anchor & salted)
    zero = np.zeros(len(marks), np.int64)
    cols = {"bucket": (bucket, r["anchor"][marks]), "anchor": (r["anchor"], r["anchor"][marks]), "kind": (r["kind"], zero.astype(np.uint64)), "doc": (r["doc"], zero), "loc": (r["loc"], zero), "n": (r["n"], zero), "state": (state, np.full(len(marks), MARK))}
    out = {k: np.concatenate((v[stay], extra)) for k, (v, extra) in cols.items()}
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int8) if k == "state" else v.view(np.int64)) for k, v in out.items()], names=list(out))


def _slices(b: pa.RecordBatch, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for b in blocks(batches, "text", PART_BYTES):
        b = b.filter(pc.is_valid(b.column("doc_id")))
        doc = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        for buf, off, row, base in _pieces(b.column("text")):
            r = runs(buf, off)
            text = r.pop("text")
            rows.append(r | {"doc": doc[row[text]], "loc": r["loc"] + base[text]})
            held += len(buf)
        if held >= LOCAL_BYTES:
            yield from _slices(_local(rows))
            rows, held = [], 0
    if rows:
        yield from _slices(_local(rows))


_SETTLED_SCHEMA = "doc long, loc long, n long, anchor long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, kind, doc, loc) -> repeated runs (anchor null) and runs left to order."""
    last_anchor = last_kind = last_doc = last_loc = None
    several, pending = False, None

    def out(doc, loc, n, anchor, mask):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(loc), pa.array(n), pa.array(anchor, mask=mask)], names=["doc", "loc", "n", "anchor"])

    for b in batches:
        if b.num_rows == 0:
            continue
        c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "kind", "doc", "loc", "n", "state")}
        done = c["state"] == DONE
        if done.any():
            yield out(c["doc"][done], c["loc"][done], c["n"][done], c["anchor"][done], done[done])
            c = {k: v[~done] for k, v in c.items()}
        size = len(c["anchor"])
        if size == 0:
            continue
        new_anchor = np.ones(size, bool)
        new_anchor[1:] = c["anchor"][1:] != c["anchor"][:-1]
        new_anchor[0] = last_anchor is None or c["anchor"][0] != last_anchor
        mark = c["state"] == MARK
        new_kind = new_anchor.copy()
        new_kind[1:] |= c["kind"][1:] != c["kind"][:-1]
        if not new_anchor[0]:
            new_kind[0] = c["kind"][0] != last_kind
        # the first row of a kind, for rows whose kind began in an earlier batch from the carried place
        head = np.maximum.accumulate(np.where(new_kind, np.arange(size), -1))
        head_doc, head_loc = np.where(head >= 0, c["doc"][head], last_doc or 0), np.where(head >= 0, c["loc"][head], last_loc or 0)
        again = ~new_kind & ~mark & ((c["doc"] != head_doc) | (c["loc"] != head_loc))
        first = new_kind & ~mark
        group = np.cumsum(new_anchor)
        weight = first.astype(np.int64) + 2 * (mark | (c["state"] == SALTED))
        kinds = np.bincount(group, weight, minlength=int(group[-1]) + 1)
        if not new_anchor[0]:
            kinds[0] += 2 if several else (pending is not None)
        else:
            pending = None
        many = kinds >= 2
        emit = first & many[group]
        if pending is not None and many[0]:  # its anchor goes on in this batch with another kind
            yield out(*[np.array([pending[k]]) for k in ("doc", "loc", "n", "anchor")], np.array([False]))
            pending = None
        take = emit | again
        if take.any():
            yield out(c["doc"][take], c["loc"][take], c["n"][take], c["anchor"][take], again[take])
        end = int(group[-1])
        several = bool(many[end])
        if end > 0:
            pending = None
        if not several and (mine := np.flatnonzero(first & (group == end))).size:
            pending = {k: int(c[k][mine[-1]]) for k in ("doc", "loc", "n", "anchor")}
        last_anchor, last_kind = int(c["anchor"][-1]), int(c["kind"][-1])
        last_doc, last_loc = int(head_doc[-1]), int(head_loc[-1])


def previous_factors(pos: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order, exact where they reach ``least``.

    ``pos``: positions in suffix order; ``lcp[i]``: common prefix of suffixes i - 1 and i. The previous and the next
    smaller position are found by following pointers over larger ones, as long as the common prefix allows.
    """

    def one_way(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        to, common = np.arange(len(pos)) - 1, lcp.copy()
        todo = np.flatnonzero((to >= 0) & (common >= least))
        todo = todo[pos[to[todo]] >= pos[todo]]
        while len(todo):
            step = to[todo]
            common[todo], to[todo] = np.minimum(common[todo], common[step]), to[step]
            todo = todo[(to[todo] >= 0) & (common[todo] >= least)]
            todo = todo[pos[to[todo]] >= pos[todo]]
        return np.where(to >= 0, common, 0)

    if len(pos) == 0:
        return np.zeros(0, np.int64)
    back = one_way(pos, np.concatenate(([0], lcp[1:])))
    ahead = one_way(pos[::-1], np.concatenate(([0], lcp[:0:-1])))[::-1]
    return np.maximum(back, ahead)


def repeated_windows(doc: np.ndarray, loc: np.ndarray, n: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, loc) of the windows of these runs that have an earlier equal one among them."""
    row = np.repeat(np.arange(len(n)), n)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum([0, *map(len, data)])[:-1]
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(data), np.uint8), LENGTH)
    suffix = np.ascontiguousarray(view[begin[row] + shift])
    d, at = doc[row], loc[row] + shift
    rank = np.empty(len(row), np.int64)
    places = np.lexsort((at, d))
    new = np.ones(len(row), bool)
    new[1:] = (d[places][1:] != d[places][:-1]) | (at[places][1:] != at[places][:-1])
    rank[places] = np.cumsum(new)
    order = np.lexsort((rank, suffix.view(f"S{LENGTH}").ravel()))
    differ = suffix[order[1:]] != suffix[order[:-1]]
    lcp = np.zeros(len(row), np.int64)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    found = previous_factors(rank[order], lcp, LENGTH) >= LENGTH
    hit = order[found]
    return d[hit], at[hit]


def first_windows(t: pa.Table, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The windows of these runs, one by one, without the repeated ones given: the first of each kind."""
    n = t["n"].to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    d, w = t["doc"].to_numpy()[row], t["loc"].to_numpy()[row] + shift
    order = np.lexsort((w, d))
    new = np.ones(len(order), bool)
    new[1:] = (d[order][1:] != d[order][:-1]) | (w[order][1:] != w[order][:-1])
    gone = set(zip(doc.tolist(), at.tolist()))
    stay = [k for k in order[new].tolist() if (int(d[k]), int(w[k])) not in gone]
    data = t["data"].to_pylist()
    one = [data[row[k]][shift[k] : shift[k] + LENGTH] for k in stay]
    cols = [t["bucket"].to_numpy()[row[stay]], d[stay], w[stay], np.ones(len(stay), np.int64)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(one, pa.binary())], names=["bucket", "doc", "loc", "n", "data"])


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with their bytes, sorted by bucket -> repeated windows, joined to runs of windows.

    Of a bucket that goes on beyond ``ORDER_BYTES`` only the first window of each kind is held.
    """

    def first_of_last(parts: list[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
        out = judge(parts)
        t = pa.Table.from_batches(parts)
        t = t.filter(pc.equal(t["bucket"], t["bucket"][-1]))
        d, at = repeated_windows(t["doc"].to_numpy(), t["loc"].to_numpy(), t["n"].to_numpy(), t["data"].to_pylist())
        return [first_windows(t, d, at)], out

    def judge(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        d, at = repeated_windows(t["doc"].to_numpy(), t["loc"].to_numpy(), t["n"].to_numpy(), t["data"].to_pylist())
        order = np.lexsort((at, d))
        d, at = d[order], at[order]
        stay = np.ones(len(d), bool)
        stay[1:] = (d[1:] != d[:-1]) | (at[1:] != at[:-1])
        d, at = d[stay], at[stay]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)
        s = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(d[s]), pa.array(at[s]), pa.array(np.diff(np.append(s, len(d))))], names=["doc", "loc", "n"])

    held, size, limit = [], 0, 2 * ORDER_BYTES
    for b in batches:
        settled = pc.equal(pc.binary_length(b.column("data")), 0)
        if pc.any(settled).as_py():
            yield b.filter(settled).select(["doc", "loc", "n"])
            b = b.filter(pc.invert(settled))
        if b.num_rows == 0:
            continue
        bucket = b.column("bucket").to_numpy()
        length = np.cumsum(pc.binary_length(b.column("data")).to_numpy())
        ends = np.append(run_starts(bucket)[1:], b.num_rows)  # where a bucket ends in this batch; the last may go on
        at = 0
        if held and held[-1].column("bucket")[-1].as_py() != bucket[0] and size >= ORDER_BYTES:
            yield judge(held)
            held, size = [], 0
        for e in ends.tolist()[:-1]:
            if size + int(length[e - 1]) - (int(length[at - 1]) if at else 0) >= ORDER_BYTES:
                yield judge([*held, b.slice(at, e - at)])
                held, size, at = [], 0, e
        if at < b.num_rows:
            held.append(b.slice(at))
            size += int(length[-1]) - (int(length[at - 1]) if at else 0)
            if size >= limit:  # the last bucket may go on
                held, out = first_of_last(held)
                yield out
                size = pc.sum(pc.binary_length(held[0].column("data"))).as_py() or 0
                limit = max(2 * ORDER_BYTES, 2 * size)
    if held:
        yield judge(held)


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their runs left to order -> the runs' bytes; hot ones as single windows, equal ones settled."""
    for b in blocks(batches, "text"):
        buf, off = utf8(b.column("text"))
        asks = b.column("asks")
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(asks).to_numpy(zero_copy_only=False).astype(np.int64))
        flat = asks.flatten()
        doc = b.column("doc_id").to_numpy().astype(np.int64)[row]
        loc, n, anchor = (flat.field(k).to_numpy() for k in ("loc", "n", "anchor"))
        hot = flat.field("hot").to_numpy(zero_copy_only=False).astype(bool)
        at = off[row] + loc
        if (~hot).any():
            k = np.flatnonzero(~hot)
            raw = buf.tobytes()
            data = [raw[s:e] for s, e in zip(at[k].tolist(), (at[k] + n[k] - 1 + LENGTH).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[k]), pa.array(doc[k]), pa.array(loc[k]), pa.array(n[k]), pa.array(data, pa.binary())], names=["bucket", "doc", "loc", "n", "data"])
        if hot.any():
            k = np.flatnonzero(hot)
            of = np.repeat(k, n[k])
            shift = np.arange(len(of)) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
            s = at[of] + shift
            key = RangeHash(BYTE_VALUE[buf])(s, s + LENGTH)
            order = np.lexsort((loc[of] + shift, doc[of], key))
            s, d, w, key = s[order], doc[of][order], (loc[of] + shift)[order], key[order]
            new = np.zeros(len(key), bool)
            new[run_starts(key)] = True
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            again = ~new & ((d != d[head]) | (w != w[head]))
            bucket = np.where(new, key, mix(key + d.astype(np.uint64))).view(np.int64)
            # a window that this block has earlier is repeated: its row has no bytes and is dealt out by document
            data = [bytes(buf[x : x + LENGTH]) if first else b"" for x, first in zip(s.tolist(), new.tolist(), strict=True)]
            stay = pa.array(new | again)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(d), pa.array(w), pa.array(np.ones(len(d), np.int64)), pa.array(data, pa.binary())], names=["bucket", "doc", "loc", "n", "data"]).filter(stay)


def _cut_out(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """Remaining bytes, bytes removed and maximal removed runs."""
    if not spans:
        return text, 0, 0
    gone = np.zeros(len(text) + 1, np.int64)
    np.add.at(gone, [s["loc"] for s in spans], 1)
    np.add.at(gone, [s["loc"] + s["n"] - 1 + LENGTH for s in spans], -1)
    gone = np.cumsum(gone[:-1]) > 0
    starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), starts


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, loc, n): windows of documents that start earlier too; n windows in a row from byte loc."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = in_arrow(texts, _find_runs, _RUN_SCHEMA).repartition(parts, "bucket").sortWithinPartitions("anchor", "kind", "doc", "loc")
    settled = store(in_arrow(found, _settle, _SETTLED_SCHEMA), "runs")
    left = settled.where("anchor IS NOT NULL")
    hot = cut(left.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > HOT_RUNS).select("anchor", F.lit(True).alias("hot")))
    left = left.join(small(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asks = left.groupBy("doc").agg(F.collect_list(F.struct("loc", "n", "anchor", "hot")).alias("asks"))
    cuts = texts.join(asks, texts["doc_id"] == asks["doc"]).select("doc_id", "text", "asks")
    rows = in_arrow(cuts, _cut_runs, "bucket long, doc long, loc long, n long, data binary")
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    ordered = in_arrow(rows, _order, "doc long, loc long, n long")
    return settled.where("anchor IS NULL").select("doc", "loc", "n").union(ordered)


def added_columns(docs: DataFrame) -> list[str]:
    """Names of the columns that ``remove_repeats`` adds: bytes, bytes removed, removed runs, digest of what remains."""
    return fresh_names(docs, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``text`` as what is left, then those of ``added_columns``.

    Where a cut splits a code point, the text leaves out the broken part; the digest is of the remaining bytes.
    """
    names, at = docs.columns, docs.columns.index("text")
    own, of = fresh_names(docs, "spans", "doc")
    more_names = added_columns(docs)
    spans = repeated(docs).groupBy(F.col("doc").alias(of)).agg(F.collect_list(F.struct("loc", "n")).alias(own))
    rows = docs.join(spans, F.col("doc_id").cast("long") == F.col(of), "left").drop(of)

    def run(batches):
        for b in blocks(batches, "text"):
            got = [_cut_out((t or "").encode(), s or []) for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            texts = [t if not k[1] else k[0].decode("utf-8", "ignore") for t, k in zip(b.column(at).to_pylist(), got, strict=True)]
            sizes = np.array([len(k[0]) + k[1] for k in got], np.int64)
            cols = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(len(names))]
            more = [pa.array(sizes), pa.array([k[1] for k in got], pa.int64()), pa.array([k[2] for k in got], pa.int64()), pa.array([hashlib.sha256(k[0]).hexdigest() for k in got])]
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[*names, *more_names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    more_kinds = ", ".join(f"`{c}` {t}" for c, t in zip(more_names, ("long", "long", "long", "string")))
    return in_arrow(rows, run, f"{kinds}, {more_kinds}")
