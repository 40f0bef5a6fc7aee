"""Periodic runs against plain restatements."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import periodic, queries
from quarry.llm.periodic import COVER, MODULUS, Block, Extensions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """All runs by trying every period at every stretch of repeated words."""
    out = {}
    n = len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in out.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()).hexdigest(),
    )


def some_words(rng):
    kind = rng.integers(5)
    size = int(rng.integers(0, 160))
    w = rng.integers(0, int(rng.integers(1, 6)), size)
    if kind == 1:
        w = np.tile(rng.integers(0, 3, int(rng.integers(1, 40))), int(rng.integers(3, 9)))
    elif kind == 2:
        w = np.concatenate([w, np.tile(w[: rng.integers(1, 60)], 5), w[::-1]])
    elif kind == 3:
        part = np.tile(rng.integers(0, 2, 3), 6)
        w = np.tile(np.concatenate([part, rng.integers(0, 9, int(rng.integers(0, 50)))]), 5)
    return w


def test_cover_has_every_difference():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


def test_extensions_against_word_by_word():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = some_words(rng) + 1
        if len(s) < 2:
            continue
        ext = Extensions(s)
        i, j = np.sort(rng.integers(0, len(s), (2, 200)), axis=0)
        i, j = i[i < j], j[i < j]
        want = []
        for a, b in zip(i.tolist(), j.tolist()):
            k = 0
            while b + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            want.append(k)
        assert ext(i, j).tolist() == want


@pytest.mark.parametrize("pairs", [1 << 20, 50])
def test_runs_of_blocks_against_every_period(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    rng = np.random.default_rng(pairs)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(int(rng.integers(1, 8)))]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        doc, start, length, p = Block(np.concatenate(texts).astype(np.int64), first).runs()
        for d, t in enumerate(texts):
            got = list(zip(*(x[doc == d].tolist() for x in (start, length, p))))
            assert got == plain_runs(t.tolist())


def test_long_run_over_the_whole_text():
    n = 40_000
    doc, start, length, p = Block(np.zeros(n, np.int64), np.array([0, n])).runs()
    assert (start.tolist(), length.tolist(), p.tolist()) == ([0], [n], [1])


def test_query_against_plain_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(None, "a b c"), (3, None), (3, ""), (5, " \t\n"), (7, "x " * 50), (7, "x " * 50), (8, "ä ö " * 30 + "end")]
    rows += [(k, " ".join(f"w{x}" for x in some_words(rng))) for k in range(10, 400)]
    rows += [(1000 + k, " ".join(f"w{x}" for x in rng.integers(0, 50, 3000))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("x")).withColumn("seed", F.lit(1))
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((d, *plain_row(d, t)) for d, t in rows), key=key)


def test_empty_table(spark):
    assert periodic.collapse(spark.createDataFrame([], "doc_id string, text string")).collect() == []
