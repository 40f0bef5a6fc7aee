"""Fill-in-the-middle against a plain restatement and an exact round trip."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import infill, queries

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    k1, k2 = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:k1]), "".join(units[k1:k2]), "".join(units[k2:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def some_rows():
    rng = np.random.default_rng(2)
    odd = ["", None, "\n", "\n\n\n", "one line", "ends\n", "a<P>b\nc", "<S>", "<M>\n", "<P", "P>", "<", ">\n<", "<<P\n>", "ä\nöü€\n𝄞", "<S\n><P\n>"]
    rows = [(k, t) for k, t in enumerate(odd * 6)] + [(None, "x\ny\nz"), (5, "repeated"), (5, "repeated"), (5, "another\ntext")]
    marks = ["<P", "<", ">", "S>", "\n", "word ", "€", "M", "<X>"]
    rows += [(1000 + k, "".join(rng.choice(marks, int(rng.integers(0, 60))))) for k in range(500)]
    return [*rows, (9999, "long line €\n" * 300_000)]


@pytest.mark.parametrize("piece", [infill.PIECE, 7])
def test_arrays_against_plain(piece, monkeypatch):
    monkeypatch.setattr(infill, "PIECE", piece)
    texts = ["ab\ncd\nef", "", "x", "\n\n", "p\nq\nr\ns\nt"] * 3
    off = np.cumsum([0] + [len(t) for t in texts])
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    draws = np.random.default_rng(0).integers(0, 1 << 32, (2, len(texts)))
    n, c1, c2 = infill.cuts(buf, off, draws)
    form = np.array([infill.PLAIN if not t else (infill.PSM, infill.SPM)[k % 2] for k, t in enumerate(texts)])
    out, new = infill.scatter(buf, off, c1, c2, form)
    for k, t in enumerate(texts):
        a, b, c = t[: c1[k] - off[k]], t[c1[k] - off[k] : c2[k] - off[k]], t[c2[k] - off[k] :]
        want = ["", f"<P>{a}<S>{c}<M>{b}", f"<S>{c}<P>{a}<M>{b}"][form[k]] if t else ""
        assert out[new[k] : new[k + 1]].tobytes().decode() == want
        assert n[k] == len(UNIT.findall(t))
    back, again = infill.gather(out, new, form)
    assert (again == off).all() and (back == buf).all()


def test_query_and_outputs(spark, tmp_path):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("h1", F.lit("x"))
    df.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: tuple((x is None, x) for x in r)
    outputs = [tuple(r) for r in infill.transform(df).collect()]
    assert sorted(outputs, key=key) == sorted(((d, *plain(d, t)) for d, t in rows), key=key)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op12_infill(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(d, *(p := plain(d, t))[:4], sha(p[4]), sha(t or "")) for d, t in rows]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_damaged_output_is_refused():
    buf = np.frombuffer(b"<P>a<S>b", np.uint8)
    with pytest.raises(ValueError, match="three markers"):
        infill.gather(buf, np.array([0, len(buf)]), np.array([infill.PSM]))
    buf = np.frombuffer(b"<P>a<S>b<M>c", np.uint8)
    with pytest.raises(ValueError, match="another order"):
        infill.gather(buf, np.array([0, len(buf)]), np.array([infill.SPM]))


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restore(infill.transform(none)).collect() == []
    rows = spark.createDataFrame([("id", "a\nb\nc")], "doc_id string, text string")
    assert infill.restore(infill.transform(rows)).first().text == "a\nb\nc"
