"""I-Match fingerprints against a plain restatement."""

import hashlib
import math
import re
import statistics
import struct

import pytest

from quarry.llm import fingerprints as fp

xxhash = pytest.importorskip("xxhash")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed


def long(x):
    return struct.pack("<q", x)


def edits(rows):
    """{(doc_id, text): edited} in descending order of the id."""
    order = sorted({(fp._NO_ID if i is None else i, signed(h(t or "")), i, t or "") for i, t in rows})
    out = {}
    for k, (_, _, i, t) in enumerate(order):
        third = len(t) // 3
        other = order[k - 1][3]
        out[i, t] = (t[: len(t) - third] + other[:third], other)
    return out


def brute(rows):
    terms = lambda t: {signed(h(w)) for w in re.split(r'[\x20\x09-\x0D.,;:!?|()"]+', t.lower()) if w}
    df = {}
    for _, t in rows:
        for w in terms(t or ""):
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    band = {w for w, c in df.items() if fp.LEAST_SHARE * n <= c <= max(fp.MOST_SHARE * n, 1)}

    def made(t):
        inside = sorted(terms(t) & band)
        if not inside:
            x = 0
            for w in terms(t):
                x ^= w
            return "x" + f"{x & (1 << 64) - 1:x}"
        s = int(math.log2(len(inside)))
        out = []
        for scale in (s, s + 1):
            codes = []
            for j in range(fp.SUBSETS):
                sub = [w for w in inside if h(long(w), struct.pack("<i", j)) & ((1 << (scale + 1)) - 1) == 0]
                codes.append(f"{h(*map(long, sub)) & 0x7FFFFFFF:x}" if sub else "-")
            out.append(".".join(codes))
        return ":".join([str(s), *out])

    out = []
    for (i, t), (edited, _) in edits(rows).items():
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), made(t), made(edited)))
    return out


def like(a, b):
    if a == b:
        return 1.0
    if a[0] == "x" or b[0] == "x":
        return 0.0
    (sa, *ca), (sb, *cb) = a.split(":"), b.split(":")
    sa, sb = int(sa), int(sb)
    if abs(sa - sb) > 1:
        return 0.0
    both = [(0, 0), (1, 1)] if sa == sb else [(max(sb - sa, 0), max(sa - sb, 0))]
    used = [(p, q) for i, j in both for p, q in zip(ca[i].split("."), cb[j].split(".")) if (p, q) != ("-", "-")]
    return sum(p == q for p, q in used) / len(used) if used else 0.0


def test_against_plain_restatement(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000, None), (1001, ""), (1002, "ab"), (1003, "Ärger, über alles")]
    given = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, fp string, k1 int").repartition(5)
    got = fp.with_edits(given).collect()
    want = {r[0]: r for r in brute(rows)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id]
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint))
    by = {r.doc_id: r.fingerprint for r in got}
    ids = sorted(by)
    for r in got:
        assert r.near_next == pytest.approx(like(r.fingerprint, by[ids[ids.index(r.doc_id) - 1]]))
    assert statistics.mean(r.near_edited for r in got) > 5 * statistics.mean(r.near_next for r in got)


def test_odd_rows(spark):
    rows = [(None, "a b c"), (3, "x y z"), (3, "x y z"), (3, "other words here"), (9, None)]
    got = fp.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 5), (3, 5), (3, 5), (3, 16), (9, 0)]
    assert len({r.fingerprint for r in got if r.n_chars == 5 and r.doc_id == 3}) == 1
    one = fp.with_edits(spark.createDataFrame(rows[1:2], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"x y x").hexdigest()[:0] + hashlib.sha256(("x y z"[:4] + "x").encode()).hexdigest()
    assert fp.with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
