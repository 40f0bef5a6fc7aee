"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text (``SAMPLE_ROWS`` distinct
texts, of each a window of ``ROW_CHARS`` code points at a place chosen by hash; with many languages shorter windows,
so that all are within ``TOTAL_CHARS``). A text is parsed against every automaton into longest matches: each phrase is the
longest piece that occurs in the language's sample. Phrases x log2(sample length) / text length estimates the
cross entropy; the language with the least wins. All texts of a block are parsed in step, as arrays; a text is
parsed whole, in pieces of ``PIECE`` symbols, so that a very long text is as many lanes instead of one.

Only text and language of the training rows are inputs; a prediction sees the text alone. Null texts and texts
without a letter give ``und`` with score 0. Repeated rows are predicted row by row; an empty table gives an
empty result; with no labelled row every language is ``und``. A null doc_id is neither held out nor learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import IS_CHAR, blocks, in_arrow, utf8

SAMPLE_ROWS = 80
ROW_CHARS = 800
#: Symbols of all languages' samples together, so that many languages stay within memory: above 10 languages every window is shortened alike.
TOTAL_CHARS = 640_000
PIECE = 2048
#: Text parsed in step at a time.
STEP_BYTES = 4 << 20
#: A language's hashes are ranked in so many parts first.
RANK_PARTS = 16
FOLDS = 5
UNDETERMINED = "und"


def fold(col: str = "doc_id"):
    """Held-out fold: crc32 of the id as text."""
    return F.crc32(F.col(col).cast("string")) % FOLDS


def _symbols(texts: list[str]) -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, 1 for a letter that no sample has, then the samples' letters."""
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
    number = {c: i + 2 for i, c in enumerate(letters)}
    table = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = number.get(low, 1) if len(low) == 1 else 1
    return table


def _squeeze(symbols: np.ndarray) -> np.ndarray:
    """Which symbols stay when runs of 0 become one."""
    stay = np.ones(len(symbols), bool)
    stay[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return stay


def common_size(sizes: list[int], room: int) -> int:
    """The largest size to which all can be cut so that they fit the room together."""
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > room:
            return room // (len(sizes) - k)
        room -= size
    return max(sizes, default=0)


def suffix_automaton(seq: list[int], width: int) -> np.ndarray:
    """Transitions [state, symbol] of the automaton of all factors of ``seq``; -1: none. State 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), width), -1, np.int32)
    for s, row in enumerate(nxt):
        for c, to in row.items():
            table[s, c] = to
    return table


class Model:
    """The automata of all languages in one table; state 0 is 'no match'."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.symbol_of = _symbols([t for ts in samples.values() for t in ts])
        width = int(self.symbol_of.max(initial=1)) + 1
        tables, roots, bits, at = [np.zeros((1, width), np.int32)], [], [], 1
        room = max(2000, TOTAL_CHARS // max(len(self.langs), 1))
        for lang in self.langs:
            texts = [self.symbol_of[np.frombuffer(t.encode("utf-32-le"), np.uint32)] for t in samples[lang]]
            texts = [t[_squeeze(t)] for t in texts]
            most = common_size(list(map(len, texts)), room)
            seq = np.concatenate([[0], *(x for t in texts for x in (t[:most], [0]))])
            seq = seq[_squeeze(seq)]
            t = suffix_automaton(seq.tolist(), width)
            tables.append(np.where(t >= 0, t + at, 0))
            roots.append(at)
            bits.append(np.log2(max(len(seq), 2)))
            at += len(t)
        self.width, self.next = width, np.concatenate(tables).astype(np.int32).ravel()
        self.root, self.bits = np.array(roots, np.int32), np.array(bits)
        start = self.next.reshape(-1, width)[self.root] if len(roots) else np.zeros((0, width), np.int32)
        #: The state after a phrase's first symbol, and whether that symbol is no phrase of the sample at all.
        self.unknown = start == 0
        self.begin = np.where(self.unknown, self.root[:, None], start).astype(np.int32)

    def phrases(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """[language, lane]: phrases of the parse of each lane symbols[start : start + size]."""
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        count = np.zeros((len(self.langs), len(order)), np.int32)
        state = np.repeat(self.root[:, None], len(order), axis=1)
        for t, n in enumerate(active.tolist()):
            s = symbols[at[:n] + t]
            to = self.next[state[:, :n] * self.width + s]
            miss = to == 0
            count[:, :n] += miss
            count[:, :n] += miss & self.unknown[:, s]
            state[:, :n] = np.where(miss, self.begin[:, s], to)
        count += 1
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(col)
        buf, off = utf8(col, end=b"\n")
        cps = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[cps]
        off = np.concatenate(([0], np.cumsum(IS_CHAR[buf])))[off]
        letters = np.add.reduceat((symbols > 0).astype(np.int64), off[:-1])
        stay = _squeeze(symbols)
        off = np.concatenate(([0], np.cumsum(stay)))[off]
        symbols = symbols[stay].astype(np.int32)
        size = np.diff(off)
        known = letters > 0
        if not self.langs or not known.any():
            return [UNDETERMINED] * n, np.zeros(n)
        pieces = np.where(known, -(-size // PIECE), 0)
        text = np.repeat(np.arange(n), pieces)
        k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lanes = self.phrases(symbols, off[text] + k * PIECE, np.minimum(size[text] - k * PIECE, PIECE))
        cost = np.stack([np.bincount(text, row, minlength=n) for row in lanes]) * self.bits[:, None] / np.maximum(size, 1)
        best = np.argmin(cost, axis=0)
        low = cost[best, np.arange(n)]
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=0)[1]
            score = np.clip(1 - low / np.maximum(second, 1e-12), 0, 1)
        else:
            score = np.ones(n)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = ROW_CHARS) -> Model:
    """Automata from at most ``rows`` distinct labelled texts a language, those of the smallest hash.

    Copies count once, and the window of a text begins at a place given by its hash, so that neither a group of
    copies nor a passage at the start of many texts makes up the sample. Only hashes are ranked.
    """
    rows_of = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0)).select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    least = Window.partitionBy("lang").orderBy("h")
    few = rows_of.select("lang", "h", F.pmod("h", F.lit(RANK_PARTS)).alias("part")).distinct()
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("r") <= rows)
    few = few.select("lang", "h").withColumn("r", F.row_number().over(least)).where(F.col("r") <= rows)
    at = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    window = F.col("text").substr(at.cast("int"), F.lit(chars))
    few = rows_of.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h", "r").agg(F.min(window).alias("t"))
    samples: dict[str, list[str]] = {}
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["r"])):
        samples.setdefault(r["lang"], []).append(r["t"])
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", STEP_BYTES):
            lang, score = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
