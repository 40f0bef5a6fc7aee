"""Passage and near-duplicate removal against brute force."""

import hashlib
import itertools
import random
import re

import pytest

from quarry.llm import neardup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, parts=3):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute_removed(texts, length=suffix_dedup.LENGTH):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} by a set of all earlier strings."""
    seen, out = set(), {}
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        runs = [k for k, _ in itertools.groupby(gone) if k]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(runs), hashlib.sha256(kept).hexdigest())
    return out


def some_texts(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    hot, line = say(40), say(14)
    texts = []
    for i in range(n):
        t = say(rng.randint(0, 120))
        kind = i % 8
        if kind == 1 and texts:
            t = rng.choice(texts) or ""
        elif kind == 2:
            t = t + " " + hot + " " + say(20)
        elif kind == 3 and texts:
            old = rng.choice(texts) or ""
            a = rng.randint(0, len(old))
            t = t + old[a : a + rng.randint(50, 400)] + say(10)
        elif kind == 4:
            t = line + "\n" + t
        elif kind == 5:
            t = "ab" * rng.randint(0, 200) + t
        texts.append(t)
    texts += [None, "", "x" * 99, "x" * 100, "x" * 260]
    return list(enumerate(texts))


@pytest.mark.parametrize("limits", [{}, {"SALT_RUNS": 2, "HOT_RUNS": 2, "ORDER_BYTES": 500}])
def test_suffix_dedup_brute(spark, monkeypatch, limits):
    texts = some_texts()
    for k, v in limits.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    if limits:  # tasks import the module afresh: hand them the limits through the functions' own module globals
        from pyspark import cloudpickle as cp

        cp.register_pickle_by_value(suffix_dedup)
    try:
        got = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    finally:
        if limits:
            cp.unregister_pickle_by_value(suffix_dedup)
    want = brute_removed(texts)
    assert {r.doc_id: (r._n_bytes, r._n_removed, r._n_spans, r._kept_sha256) for r in got} == want
    assert any(v[1] for v in want.values())


def test_suffix_dedup_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [(1, passage), (1, passage), (2, passage), (None, passage), (3, None), (4, "")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r._n_removed) for r in suffix_dedup.remove_repeats(frame(spark, texts)).fillna({"text": "-"}).collect())
    n = len(passage)
    assert got == [(-1, passage, 0), (1, passage, 0), (1, passage, 0), (2, "", n), (3, "-", 0), (4, "", 0)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_previous_factors():
    import numpy as np

    text = b"abracadabra" * 3 + b"cadabraabra"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(len(text) - max(a, b)) if text[a + k] != text[b + k]), len(text) - max(a, b))
    lcp = np.array([0] + [common(a, b) for a, b in itertools.pairwise(order)])
    got = np.empty(len(text), int)
    got[order] = suffix_dedup.previous_factors(np.array(order), lcp, 1)
    assert got.tolist() == [max([common(j, i) for j in range(i)], default=0) for i in range(len(text))]


def shingle_set(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, percent=80):
    sets = {i: shingle_set(t, k) for i, t in texts}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for g in range(14):
        base = rng.choices(words, k=rng.randint(3, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6) if g else 60):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 35)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    chain = rng.choices(words, k=200)
    for _ in range(12):  # each like the one before, the ends unlike
        at = rng.randrange(190)
        chain = chain[:at] + rng.choices(words, k=7) + chain[at + 7 :]
        texts.append(" ".join(chain))
    texts += [None, "", " \n", "one", "One", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "rows"), [(4, 2048), (5, 2048), (4, 5)])
def test_neardup_brute(spark, monkeypatch, k, rows):
    texts = near_texts()
    monkeypatch.setattr(neardup, "GROUP_ROWS", rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(frame(spark, texts), k=k).collect()}
    want = brute_components(texts, k)
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts)


def test_neardup_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = neardup.link(frame(spark, [(5, t), (5, t), (9, t), (None, t), (7, None)])).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None)
    assert got == [(5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert [r.kept for r in rows if r.doc_id is None] == [True]
    assert neardup.link(frame(spark, [])).count() == 0
    assert sorted(r.doc_id for r in neardup.first_of_each(frame(spark, [(5, t), (9, t), (7, None)])).collect()) == [5, 7]


def test_rows_that_share_an_id_with_different_texts(spark):
    rng = random.Random(2)
    a, b = (" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(2))
    docs = spark.createDataFrame([(5, a), (9, a), (9, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.first_of_each(docs).collect()) == sorted([(5, a), (9, b)])


def test_clashing_names(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=400))
    docs = spark.createDataFrame([(1, text, 7, 8, "x"), (2, text, 7, 8, "x")], "doc_id long, text string, _n_bytes int, _spans int, __doc string")
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "__n_bytes", "_n_removed", "_n_spans", "_kept_sha256"]
    assert sorted((r.doc_id, len(r.text), r._n_bytes, r["__n_bytes"]) for r in out.collect()) == [(1, 400, 7, 400), (2, 0, 7, 400)]


def test_hot_passage_with_small_blocks(spark, monkeypatch):
    """A bucket that goes on over many batches is held by its first windows only; the result stays."""
    rng = random.Random(4)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    hot = say(300)
    rows = [(k, say(50) + hot[rng.randint(0, 60) :] + say(60)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_removed(rows)
    sent = []
    for order_bytes, hot_runs in ((400, 2), (1 << 20, 512), (400, 512)):
        batches = []
        monkeypatch.setattr(suffix_dedup, "ORDER_BYTES", order_bytes)
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot_runs)
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", 500)
        got = {r.doc_id: (r._n_bytes, r._n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == {k: v[:2] for k, v in want.items()}


def test_order_holds_first_windows_only(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "ORDER_BYTES", 300)
    held = []
    kept = suffix_dedup.first_windows
    monkeypatch.setattr(suffix_dedup, "first_windows", lambda *a: held.append(kept(*a)) or held[-1])
    data = [bytes([65 + k % 3]) * 100 for k in range(60)]
    doc = np.arange(60)[::-1].copy()

    def batch(a, b):
        n = b - a
        cols = [pa.array([7] * n, pa.int64()), pa.array(doc[a:b]), pa.array([0] * n, pa.int64()), pa.array([1] * n, pa.int64()), pa.array(data[a:b], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "doc", "loc", "n", "data"])

    out = [x for b in suffix_dedup._order(iter([batch(a, a + 5) for a in range(0, 60, 5)])) for x in b.column("doc").to_pylist()]
    assert sorted(out) == list(range(3, 60)) and held and max(h.num_rows for h in held) <= 3
