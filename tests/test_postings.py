"""Occurrences by postings against a plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import postings
from quarry.operators import secrets as se


@pytest.mark.parametrize("bits,block", [(26, 1 << 20), (8, 200)])
def test_occurrences_against_plain_search(spark, monkeypatch, bits, block):
    """Short, long and odd strings; a small bitmap, in which nearly all grams look wanted, changes nothing."""
    monkeypatch.setattr(postings, "BITMAP_BITS", bits)
    monkeypatch.setattr(postings, "BLOCK_BYTES", block)
    rng = random.Random(2)
    say = lambda k: "".join(rng.choice("abcdé€ \n") for _ in range(k))
    texts = [(k, rng.choice("pq"), say(rng.randint(0, 400))) for k in range(120)] + [(500, "p", None), (501, "q", ""), (502, "p", "ab\0cd")]
    strings = [(s, say(rng.randint(1, 14))) for s in "pq" for _ in range(60)]
    strings += [("p", texts[k][2][a : a + 20]) for k in range(30) for a in (0, 7)] + [("q", ""), ("p", "b\0c"), ("p", "€"), ("r", "a"), ("p", "ab")]
    t = spark.createDataFrame(texts, "id int, scope string, text string").repartition(4)
    s = spark.createDataFrame(strings, "scope string, string string")
    got = [(r.id, r.string) for r in postings.occurrences(t, s, ["id"], scoped=True).collect()]
    want = {(k, x) for k, p, text in texts for q, x in strings if p == q and x and x in (text or "")}
    assert sorted(got) == sorted(want)
    free = [(r.id, r.string) for r in postings.occurrences(t.drop("scope"), s, ["id"]).collect()]
    assert sorted(free) == sorted({(k, x) for k, _, text in texts for _, x in strings if x and x in (text or "")})
    assert postings.occurrences(t, s.limit(0), ["id"], scoped=True).collect() == []


def test_redaction_against_plain_replacing(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("ABCDEFGHJK0123") for _ in range(rng.randint(3, 16))) for _ in range(60)]
    values += [v + "x" for v in values[:20]] + ["SECRET", "é€é€é€é€é"]
    texts = [" ".join(rng.choice([*values, "word", "and"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = [(k, t, k) for k, t in enumerate([*texts, texts[0], None, ""])]
    files = spark.createDataFrame(rows, "ord int, content string, digest int").repartition(5)
    got = {r.ord: r.content for r in se.redact_values(files, spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    for k, t, _ in rows:
        want = t
        for v in sorted(set(values), key=lambda v: (-len(v), v)):
            if t and v in t:
                want = want.replace(v, se.REDACTION)
        assert got[k] == want
    assert se.redact_values(files, spark.createDataFrame([], "value string")).where(F.col("content").contains(se.REDACTION)).count() == 0
