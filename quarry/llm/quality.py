"""Quality rules: word, symbol, line and repetition counts judged by an isolation forest.

The forest is fitted on the rule statistics of a bounded sample of labelled rows (``SAMPLE_ROWS``): for each
rate, how far it lies outside the band that holds all but ``2 * BAND`` of the rows labelled good. The threshold
on its anomaly score is calibrated on the same labels, so that at most ``MAX_FALSE`` of the rows labelled good
are rejected. Every document is counted and scored in its own task in one pass, with no shuffle.

Nulls and empty texts have no words and fail the base rules. Repeated rows are judged row by row. An empty
table gives an empty result. Without both good and bad labels nothing but the base rules rejects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BYTE_VALUE, IS_CHAR, IS_WHITE, RangeHash, blocks, in_arrow, mix, utf8, words

SAMPLE_ROWS = 8192
TREES = 128
TREE_ROWS = 256
MAX_FALSE = 0.002
BAND = 0.001
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SEED = 7

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _same_in_text(text_of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of (text, hash), and where a sorted entry equals the one before."""
    keys = mix(hashes + text_of.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.concatenate(([False], keys[1:] == keys[:-1])) if len(keys) else np.zeros(0, bool)


def rule_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """The rule statistics of each text, whole texts, as int64 arrays."""
    n = len(col)
    if n == 0:
        return {k: np.zeros(0, np.int64) for k in COUNTS}
    buf, off = utf8(col, end=b"\n")
    start = off[:-1]
    black = ~IS_WHITE[buf]
    out = {
        "word_chars": np.add.reduceat((black & IS_CHAR[buf]).astype(np.int64), start),
        "n_symbols": np.add.reduceat(IS_SYMBOL[buf].astype(np.int64), start),
    }
    ranges = RangeHash(BYTE_VALUE[buf])
    w0, w1 = words(buf)
    text_of = np.searchsorted(off, w0, side="right") - 1
    out["n_words"] = np.bincount(text_of, minlength=n)

    ends = np.flatnonzero(buf == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    seen = np.concatenate(([0], np.cumsum(black)))
    full = seen[ends] > seen[begins]
    begins, ends = begins[full], ends[full]
    line_text = np.searchsorted(off, begins, side="right") - 1
    order, again = _same_in_text(line_text, ranges(begins, ends))
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = np.bincount(line_text[order[again]], minlength=n)

    covered = np.zeros(len(w0) + 1, np.int64)
    if len(w0) >= WINDOW:
        first = np.flatnonzero(text_of[: len(w0) - WINDOW + 1] == text_of[WINDOW - 1 :])
        order, again = _same_in_text(text_of[first], RangeHash(ranges(w0, w1))(first, first + WINDOW))
        twice = again.copy()
        twice[:-1] |= again[1:]
        hit = first[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(text_of[inside], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def rates(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that do not depend on a text's length."""
    n = np.maximum(c["n_words"], 1)
    each = (c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n)
    return np.stack(each, axis=1).astype(np.float64)


def good_band(x: np.ndarray) -> np.ndarray:
    """Lower and upper end, for each rate, of nearly all the rows."""
    return np.quantile(x, [BAND, 1 - BAND], axis=0)


def features(c: dict[str, np.ndarray], band: np.ndarray) -> np.ndarray:
    """How far each rate is below (negative) or above the band, in widths of the band."""
    x, (low, high) = rates(c), band
    return (np.maximum(x - high, 0) + np.minimum(x - low, 0)) / np.maximum(high - low, 0.05)


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    many = np.maximum(n, 3.0)
    return np.where(n > 2, 2 * (np.log(many - 1) + 0.5772156649) - 2 * (n - 1) / many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Isolation trees as arrays: feature (-1 at a leaf), cut, children, and path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    rows: int
    threshold: float = np.inf
    band: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): rows that few random splits isolate come near 1."""
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(64):
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                value = x[np.arange(len(x)), np.maximum(f, 0)]
                node = np.where(inner, np.where(value < self.cut[t, node], self.left[t, node], self.right[t, node]), node)
            total += self.path[t, node]
        return np.exp2(-total / len(self.feature) / max(float(_mean_path(self.rows)), 1e-9))


def fit_forest(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    size = 2 * rows + 1
    f, c = np.full((trees, size), -1, np.int32), np.zeros((trees, size))
    le, ri, path = np.zeros((trees, size), np.int32), np.zeros((trees, size), np.int32), np.zeros((trees, size))
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), rows, replace=False)], 0)], 1
        while todo:
            node, part, d = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            free = np.flatnonzero(high > low)
            if d >= depth or len(part) <= 1 or len(free) == 0:
                path[t, node] = d + _mean_path(np.array(len(part)))
                continue
            k = int(rng.choice(free))
            at = rng.uniform(low[k], high[k])
            at = at if at > low[k] else high[k]
            below = part[:, k] < at
            f[t, node], c[t, node], le[t, node], ri[t, node] = k, at, used, used + 1
            todo += [(used, part[below], d + 1), (used + 1, part[~below], d + 1)]
            used += 2
    return Forest(f, c, le, ri, path, rows)


def calibrate(score: np.ndarray, good: np.ndarray, max_false: float = MAX_FALSE) -> float:
    """The score above which to reject: most labelled bad rows, at most ``max_false`` of the good ones."""
    if not (~good).any():
        return np.inf
    best, threshold = 0, np.inf
    values = np.unique(score)
    for at in (values[:-1] + values[1:]) / 2:
        if (score[good] > at).sum() <= max_false * good.sum() and (caught := int((score[~good] > at).sum())) > best:
            best, threshold = caught, float(at)
    return threshold


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text"):
        c = rule_counts(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_good"), *[pa.array(c[k]) for k in COUNTS]], names=["doc_id", "_good", *COUNTS])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Forest and threshold from at most ``sample_rows`` labelled rows, chosen by a hash of their id."""
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", (F.col("_q") > 0).alias("_good"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    schema = "doc_id long, _good boolean, " + ", ".join(f"{k} long" for k in COUNTS)
    got = in_arrow(rows.select("doc_id", "text", "_good"), _count_rows, schema).toPandas().sort_values("doc_id")
    counts = {k: got[k].to_numpy(np.int64) for k in COUNTS}
    use = ~base_failed(counts) if len(got) else np.zeros(0, bool)
    counts = {k: v[use] for k, v in counts.items()}
    good = got["_good"].to_numpy(bool)[use]
    if not good.any():
        return None
    band = good_band(rates(counts)[good])
    x = features(counts, band)
    forest = fit_forest(x)
    forest.band = band
    forest.threshold = calibrate(forest.score(x), good)
    return forest


def judge(col: pa.Array, forest: Forest | None) -> dict[str, np.ndarray]:
    c = rule_counts(col)
    failed = base_failed(c)
    score = np.zeros(len(failed))
    if forest is not None and len(failed):
        rows, back = np.unique(features(c, forest.band), axis=0, return_inverse=True)
        score = forest.score(rows)[back.ravel()]
    return c | {"base_failed": failed, "anomaly": score, "kept": ~failed & ~(score > (forest.threshold if forest else np.inf))}


def score(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, anomaly)."""
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "anomaly"]

    def run(batches):
        for b in blocks(batches, "text"):
            got = judge(b.column("text"), forest)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(got[k]) for k in cols]], names=["doc_id", *cols])

    kinds = {"base_failed": "boolean", "kept": "boolean", "anomaly": "double"}
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {kinds.get(k, 'long')}" for k in cols)
    return in_arrow(docs.select("doc_id", "text"), run, schema)


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are; one pass, no shuffle."""

    def run(batches):
        for b in blocks(batches, "text"):
            yield b.filter(pa.array(judge(b.column("text"), forest)["kept"]))

    return in_arrow(docs, run, docs.schema)
