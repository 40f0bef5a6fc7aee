"""Runs of periodic words, by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least
``max(LEAST, TIMES * q)`` words. The words of a block of texts are one sequence of numbers, with a number of its
own after each text.

1. Harmonic grid: a run with period p holds a multiple of ``(TIMES - 1) * p`` whose word is repeated p places later.
   So for all p only n / ((TIMES - 1) * p) pairs of places are looked at, n log n in all, at once for a block.
2. A pair whose words agree is extended both ways word by word, over less than a period of the cover. Most end there.
3. What still agrees is extended by the cover (``Extensions``): only suffixes that begin at a place of the cover
   (6 of 31) are sorted, by their first 31 words and then by doubling ranks; from any two places at most 30 words lead
   to a pair of sorted suffixes, and a sparse table over the neighbours' common prefixes gives the rest. It is built
   only for the texts that need it, once forwards and once backwards.
4. An extended pair that is long enough is a run; multiples of its period give the same stretch, the least one stays.

Null texts have no words. Null ids are kept. Rows that repeat an id are rows of their own. Columns besides doc_id and
text are not looked at. A text is handled whole: memory grows with the longest text, not with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blocks, in_arrow, utf8, words

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: A difference cover modulo 31; every remainder is a difference of two of its members.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Pairs of places looked at in one go.
PAIRS = 1 << 20

SCHEMA = "doc_id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _steps_to_cover() -> np.ndarray:
    """For two remainders, the fewest places after which both are in the cover."""
    held = np.zeros(2 * MODULUS, bool)
    held[list(COVER)] = held[[c + MODULUS for c in COVER]] = True
    i, j, d = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    both = held[(i + d) % MODULUS] & held[(j + d) % MODULUS]
    assert both.any(2).all()
    return both.argmax(2)


STEPS = _steps_to_cover()


def agree(s: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """How many places from i and j on agree, at most ``most``, compared one by one."""
    most = np.broadcast_to(most, i.shape)
    got = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    step = 0
    while live.size:
        live = live[s[i[live] + step] == s[j[live] + step]]
        step += 1
        got[live] = step
        live = live[most[live] > step]
    return got


class Extensions:
    """Longest common extensions of any two places i < j of a sequence of numbers from 1."""

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        self.s = s = np.concatenate([letters, np.zeros(2 * MODULUS, letters.dtype)])
        classes = [np.arange(c, n + 1, MODULUS) for c in COVER]
        place = np.concatenate(classes)
        ends = np.cumsum([len(c) for c in classes])
        end = np.repeat(ends, [len(c) for c in classes])
        k = len(place)
        self.rank_at = np.zeros(n + 2 * MODULUS, np.int32)
        if k < 2:
            self.table = np.zeros((1, 1), np.int32)
            return
        window = np.lib.stride_tricks.sliding_window_view(s, MODULUS)[place].astype(">i4")
        keys = window.view(f"S{4 * MODULUS}").ravel()
        _, rank = np.unique(keys, return_inverse=True)
        del window, keys
        at = np.arange(k)

        def after(x: np.ndarray, step: int) -> np.ndarray:
            y = x + step
            return np.where(y < end[np.minimum(x, k - 1)], y, k)

        levels = [np.append(rank + 1, 0)]
        while levels[-1].max() < k:
            rank = levels[-1]
            pair = rank[:-1].astype(np.int64) * (k + 1) + rank[after(at, 1 << (len(levels) - 1))]
            _, rank = np.unique(pair, return_inverse=True)
            levels.append(np.append(rank + 1, 0))
        order = np.argsort(levels[-1][:-1])
        self.rank_at[place] = levels[-1][:-1] - 1
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(k - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            same = (a < k) & (b < k) & (levels[level][a] == levels[level][b])
            common += same * (MODULUS << level)
            a, b = np.where(same, after(a, 1 << level), a), np.where(same, after(b, 1 << level), b)
        common += agree(s, place[a], place[b], MODULUS)
        rows = [common.astype(np.int32)]
        while 1 << len(rows) <= k - 1:
            half = 1 << (len(rows) - 1)
            nxt = rows[-1].copy()
            nxt[:-half] = np.minimum(rows[-1][:-half], rows[-1][half:])
            rows.append(nxt)
        self.table = np.stack(rows)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        steps = STEPS[i % MODULUS, j % MODULUS]
        got = agree(self.s, i, j, steps)
        far = np.flatnonzero(got == steps)
        a, b = self.rank_at[i[far] + steps[far]], self.rank_at[j[far] + steps[far]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(high - low)[1] - 1
        got[far] += np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        return got


class Block:
    """The words of several texts as one sequence, a number of its own after each text."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        docs = len(first) - 1
        self.first, self.n = first, np.diff(first)
        self.base = first[:-1] + np.arange(docs)
        top = int(ids.max()) + 2 if len(ids) else 1
        self.s = np.zeros(len(ids) + docs + MODULUS + 1, np.int64)
        doc_of = np.repeat(np.arange(docs), self.n)
        self.s[np.arange(len(ids)) + doc_of] = ids + 1
        self.s[self.base + self.n] = top + np.arange(docs)
        self.size = len(ids) + docs
        self.built: np.ndarray | None = None

    def _grid(self):
        """(text, place, period) of the grid, in portions of about ``PAIRS``."""
        step = TIMES - 1
        top = np.where(self.n >= LEAST, self.n // TIMES, 0)
        for a, b in _portions(top, PAIRS):
            doc = np.repeat(np.arange(a, b), top[a:b])
            p = np.arange(len(doc)) - np.repeat(np.cumsum(top[a:b]) - top[a:b], top[a:b]) + 1
            count = -(-(self.n[doc] - p) // (step * p))
            for c, d in _portions(count, PAIRS):
                row = np.repeat(np.arange(c, d), count[c:d])
                k = np.arange(len(row)) - np.repeat(np.cumsum(count[c:d]) - count[c:d], count[c:d])
                yield doc[row], self.base[doc[row]] + k * step * p[row], p[row]

    def _build(self, docs: np.ndarray) -> None:
        """Extensions over the texts given and those that are built already."""
        if self.built is not None:
            if np.isin(docs, self.built).all():
                return
            docs = np.union1d(docs, self.built)
        self.built = docs
        size = self.n[docs] + 1
        self.shift = np.zeros(len(self.n), np.int64)
        start = np.cumsum(size) - size
        self.shift[docs] = start - self.base[docs]
        part = self.s[np.arange(size.sum()) + np.repeat(self.base[docs] - start, size)]
        self.ahead = Extensions(part)
        self.back = Extensions(part[::-1].copy())
        self.last = len(part) - 1

    def _extended(self, doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._build(np.unique(doc))
        i, j = i + self.shift[doc], j + self.shift[doc]
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        back[inner] = self.back(self.last - (j[inner] - 1), self.last - (i[inner] - 1))
        return back, self.ahead(i, j)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, length, period) of all runs, by text, start and period."""
        mirrored = self.s[: self.size][::-1]
        mirrored = np.concatenate([mirrored, np.zeros(MODULUS + 1, np.int64)])
        found = [np.zeros((4, 0), np.int64)]
        for doc, i, p in self._grid():
            hit = np.flatnonzero(self.s[i] == self.s[i + p])
            doc, i, p = doc[hit], i[hit], p[hit]
            need = np.maximum((TIMES - 1) * p, LEAST - p)
            ahead = agree(self.s, i, i + p, MODULUS)
            top = self.size - 1
            # The last place of the mirrored sequence is place 0: at a text's first word there is nothing before.
            inside = np.minimum(i - self.base[doc], MODULUS)
            back = agree(mirrored, top - (i + p - 1), top - (i - 1), inside)
            open_end = (ahead == MODULUS) | (back == MODULUS)
            more = np.flatnonzero(open_end)
            if more.size:
                back[more], ahead[more] = self._extended(doc[more], i[more], i[more] + p[more])
            good = back + ahead >= need
            doc, i, p, back, ahead = (x[good] for x in (doc, i, p, back, ahead))
            found.append(np.stack([doc, i - back - self.base[doc], back + ahead + p, p]))
            if len(found) > 8:
                found = [_distinct(np.concatenate(found, 1))]
        doc, start, length, p = _distinct(np.concatenate(found, 1))
        order = np.lexsort((p, start, doc))
        return doc[order], start[order], length[order], p[order]


def _portions(sizes: np.ndarray, limit: int):
    """Ranges [a, b) of rows whose sizes sum up to ``limit`` at most, one row at least."""
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        yield a, b
        a = b


def _distinct(rows: np.ndarray) -> np.ndarray:
    """One row per (text, start, length), that with the least period."""
    doc, start, length, p = rows
    order = np.lexsort((p, length, start, doc))
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(0)
    return rows[:, new]


def spread_tail(n: np.ndarray, doc_of: np.ndarray, at: np.ndarray, g: np.ndarray, edited: np.ndarray) -> np.ndarray:
    """For every word its source: in an edited text the words from g % n on repeat with a period (see ``collapse``)."""
    a = np.where(edited, g % np.maximum(n, 1), n)
    p = 1 + (n - a) // (3 + g % 8)
    a, p = a[doc_of], p[doc_of]
    return np.where(at >= a, a + (at - a) % p, at)


def _collapse(batches):
    for batch in blocks(batches, "text"):
        buf, off = utf8(batch.column("text"), end=b" ")
        start, end = words(buf)
        inside = np.zeros(len(buf) + 1, np.int8)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        letters = buf[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        cut = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=cut[1:])
        word = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(letters)]).dictionary_encode()
        ids = word.indices.to_numpy().astype(np.int64)
        first = np.searchsorted(start, off)
        n = np.diff(first)
        doc_of = np.repeat(np.arange(len(n)), n)
        edit = batch.column("edit").to_numpy(zero_copy_only=False)
        g = pc.fill_null(batch.column("seed"), 0).to_numpy()
        at = np.arange(len(ids)) - first[doc_of]
        ids = ids[first[doc_of] + spread_tail(n, doc_of, at, g, edit.astype(bool))]
        doc, begin, length, period = Block(ids, first).runs()
        dropped = np.zeros(len(ids) + 1, np.int64)
        np.add.at(dropped, first[doc] + begin + period, 1)
        np.add.at(dropped, first[doc] + begin + length, -1)
        keep = np.cumsum(dropped)[:-1] == 0
        left = np.zeros(len(n) + 1, np.int32)
        np.cumsum(np.bincount(doc_of[keep], minlength=len(n)), out=left[1:])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), word.dictionary.take(pa.array(ids[keep]))), b" ")
        rows = pa.StructArray.from_arrays([pa.array(begin), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)), rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n.astype(np.int64)), runs, text.cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def collapse(docs: DataFrame, seed=None, edit=None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs by start and period, and the text whose runs keep
    their first period only, its words joined by one space.

    Where ``edit`` (a condition on ``docs``) holds, the n words are first made periodic: each word i >= a becomes
    word a + (i - a) % p, with a = seed % n and p = 1 + (n - a) // (3 + seed % 8).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    seed = F.lit(0) if seed is None else seed
    edit = F.lit(False) if edit is None else edit
    rows = docs.select("doc_id", "text", seed.cast("long").alias("seed"), F.coalesce(edit, F.lit(False)).alias("edit"))
    return in_arrow(rows, _collapse, SCHEMA.format(id=kind))


def more_repeated(a, b):
    """Of two runs (columns) that with the greater length/period, compared exactly; the first one if they are equal."""
    return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
