"""Fill-in-the-middle texts by displacement scatter, and the way back by gather.

A text is cut into lines (a line keeps its line feed) and, by numbers drawn from its doc_id, into prefix, middle
and suffix. The texts of a batch are one byte buffer. Every segment moves as a whole, so the cuts of the batch are
the places where a byte's shift changes: the changes go into a difference array, its running sum is the shift of
every byte, and one scatter writes all outputs. Restoring scans an output for its three markers and builds the
same arrays the other way round: a gather takes every byte of the text from its place. Shifts are made in pieces
of ``PIECE`` bytes, so beside a long text and its output little is held.

A text that is empty or holds a marker stays plain, so the three markers of an output are its only ones. Null
texts are empty. A null id is drawn for as the empty id. Rows that repeat an id are rows of their own; rows with the
same id and text get the same output. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blocks, in_arrow, utf8

#: The markers; all have three bytes and differ in the second one.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
SEED = 7
#: Of 100 texts that can be transformed, so many are, and so many of those with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
PIECE = 1 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"], object)

SCHEMA = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


def shifts(size: int, at: np.ndarray, change: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, shift of each byte low..high-1): running sums of the changes of shift at ascending places."""
    carry = 0
    for low in range(0, size, PIECE):
        high = min(size, low + PIECE)
        a, b = np.searchsorted(at, (low, high))
        diff = np.zeros(high - low, np.int64)
        np.add.at(diff, at[a:b] - low, change[a:b])
        diff[0] += carry
        shift = np.cumsum(diff)
        carry = int(shift[-1])
        yield low, high, shift


def changes(starts: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending segment starts and the change of shift at each, from the shift of each segment."""
    return starts, np.diff(shift, prepend=0)


def marks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places of the markers that lie inside one text."""
    if len(buf) < MARK:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((buf[:-2] == PREFIX[0]) & (buf[2:] == PREFIX[2]))
    second = buf[at + 1]
    at = at[(second == PREFIX[1]) | (second == SUFFIX[1]) | (second == MIDDLE[1])]
    return at[at + MARK <= off[np.searchsorted(off, at, side="right")]]


def cuts(buf: np.ndarray, off: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and its two cuts as places in the buffer, from two drawn numbers a text."""
    feeds = np.flatnonzero(buf == 10)
    first = np.searchsorted(feeds, off)
    whole = np.diff(first)
    size = np.diff(off)
    open_end = size > 0
    open_end[open_end] = buf[off[1:][open_end] - 1] != 10
    n = whole + open_end
    k = np.sort(draws % (n + 1), axis=0)
    ends = np.append(feeds + 1, 0)  # the 0 is read for no unit and for the open last line, and replaced
    inner = (k > 0) & (k <= whole)
    cut = ends[np.where(inner, first[:-1] + k - 1, len(feeds))]
    cut = np.where(inner, cut, np.where(k == 0, off[:-1], off[1:]))
    return n, cut[0], cut[1]


def scatter(buf: np.ndarray, off: np.ndarray, c1: np.ndarray, c2: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all texts as one buffer, and their offsets."""
    moved = form != PLAIN
    new = np.zeros(len(off), np.int64)
    np.cumsum(np.diff(off) + 3 * MARK * moved, out=new[1:])
    o, a, b, c = new[:-1], c1 - off[:-1], c2 - c1, off[1:] - c2
    spm = form == SPM
    to_a = o + MARK + np.where(spm, MARK + c, 0)
    to_c = o + MARK + np.where(spm, 0, MARK + a)
    to_b = o + 3 * MARK + a + c
    shift = np.stack([to_a - off[:-1], to_b - c1, to_c - c2], 1)
    shift[~moved] = (o - off[:-1])[~moved, None]
    at, change = changes(np.stack([off[:-1], c1, c2], 1).ravel(), shift.ravel())
    out = np.empty(int(new[-1]), np.uint8)
    for low, high, s in shifts(len(buf), at, change):
        out[s + np.arange(low, high)] = buf[low:high]
    for mark, place in ((PREFIX, to_a), (SUFFIX, to_c), (MIDDLE, to_b)):
        for k in range(MARK):
            out[place[moved] - MARK + k] = mark[k]
    return out, new


def gather(buf: np.ndarray, off: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of all outputs as one buffer, and their offsets; ValueError where an output has not its three markers."""
    moved = form != PLAIN
    at = marks(buf, off)
    doc = np.searchsorted(off, at, side="right") - 1
    at, doc = at[moved[doc]], doc[moved[doc]]
    if len(at) != 3 * moved.sum() or (doc != np.repeat(np.flatnonzero(moved), 3)).any():
        raise ValueError("an output has not its three markers")
    at = at.reshape(-1, 3)
    spm = form[moved] == SPM
    order = np.where(spm[:, None], [[SUFFIX[1], PREFIX[1], MIDDLE[1]]], [[PREFIX[1], SUFFIX[1], MIDDLE[1]]])
    if (buf[at + 1] != order).any() or (at[:, 0] != off[:-1][moved]).any():
        raise ValueError("an output has its markers in another order")
    new = np.zeros(len(off), np.int64)
    np.cumsum(np.diff(off) - 3 * MARK * moved, out=new[1:])
    one, two, three = at.T  # a segment lies between each marker and the next, the last one up to the end
    size_one, size_two = two - one - MARK, three - two - MARK
    from_a = np.where(spm, two, one) + MARK
    from_c = np.where(spm, one, two) + MARK
    size_a, size_c = np.where(spm, size_two, size_one), np.where(spm, size_one, size_two)
    start = np.repeat(new[:-1, None], 3, 1)
    shift = np.repeat((off[:-1] - new[:-1])[:, None], 3, 1)
    end = new[1:][moved]
    start[moved] = np.stack([new[:-1][moved], new[:-1][moved] + size_a, end - size_c], 1)
    shift[moved] = np.stack([from_a, three + MARK, from_c], 1) - start[moved]
    at, change = changes(start.ravel(), shift.ravel())
    out = np.empty(int(new[-1]), np.uint8)
    for low, high, s in shifts(len(out), at, change):
        out[low:high] = buf[s + np.arange(low, high)]
    return out, new


def strings(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(buf)])


def _transform(batches):
    for batch in blocks(batches, "text"):
        buf, off = utf8(batch.column("text"))
        h1, h2, h3, h4 = (batch.column(c).to_numpy() for c in ("h1", "h2", "h3", "h4"))
        n, c1, c2 = cuts(buf, off, np.stack([h1, h2]))
        form = np.where(h4 % 100 < SUFFIX_FIRST, SPM, PSM)
        form[(np.diff(off) == 0) | (h3 % 100 >= RATE)] = PLAIN
        form[np.searchsorted(off, marks(buf, off), side="right") - 1] = PLAIN
        parts = strings(buf, np.append(np.stack([off[:-1], c1, c2], 1).ravel(), off[-1]))
        chars = pc.utf8_length(parts).to_numpy().reshape(-1, 3).astype(np.int64)
        out, new = scatter(buf, off, c1, c2, form)
        plain = form == PLAIN
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n.astype(np.int64)),
                pa.array(FORMS[form], pa.string()),
                pa.array(chars[:, 0], mask=plain),
                pa.array(chars[:, 1], mask=plain),
                strings(out, new),
            ],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: units, and code points of the segments."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text", *numbers), _transform, SCHEMA.format(id=kind))


def _restore(batches):
    for batch in blocks(batches, "output"):
        buf, off = utf8(batch.column("output"))
        form = pc.index_in(batch.column("form"), pa.array(FORMS, pa.string())).to_numpy()
        text, new = gather(buf, off, form)
        names = [c for c in batch.schema.names if c != "output"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), strings(text, new)], names=[*names, "text"])


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` with their texts rebuilt from ``output`` and ``form`` alone, in a column ``text`` in place of ``output``."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields if f.name != "output"]
    return in_arrow(outputs, _restore, ", ".join([*fields, "text string"]))
