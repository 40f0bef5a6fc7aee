"""Whole jobs that stay within memory and time as tables grow."""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
import pytest

from quarry.sources import archive as ar


@pytest.mark.parametrize("compress", [True, False])
def test_compressor_gives_rows_on_in_small_batches(compress):
    texts = [bytes([65 + i]) * 1000 for i in range(20)]
    given = texts if compress else [zlib.compress(x) for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array([*given, None, b"no stream"], pa.binary())], names=["n", "v"])
    out = list(ar._zlib("v", "o", compress, 40 if compress else 3000)([batch, batch.slice(0, 0)]))
    assert len(out) > 5 and max(b.num_rows for b in out) <= 4
    assert [x for b in out for x in b.column("n").to_pylist()] == list(range(22))
    got = [x for b in out for x in b.column("o").to_pylist()]
    if compress:
        assert [x and zlib.decompress(x) for x in got] == [*texts, None, b"no stream"]
    else:
        assert got == [*texts, None, None]


def test_archives_are_read_once_whatever_their_status(spark):
    seen = spark.sparkContext.accumulator(0)
    good = zlib.compress(json.dumps({"a": "x", "b": None}).encode())

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("p", 0, good), ("q", 1, None), ("r", 2, b"no stream")], "project string, shard int, z binary")
    frame = F.concat(F.lit(ar.BLOCK_START + "\n \t"), F.base64("z"), F.lit("\n\n" + ar.BLOCK_END + " " + ar.BLOCK_END))
    docs = rows.mapInPandas(counted, rows.schema).select("project", "shard", frame.alias("block"))
    got = sorted((r.project, r.status, r.path, r.content) for r in ar.unpack(docs).collect())
    assert got == [("p", "legacy", "a", "x"), ("p", "legacy", "b", None), ("q", "missing", None, None), ("r", "corrupt", None, None)]
    assert seen.value == 3  # twice three before: once for the archives opened, once for the others


def test_context_document_holds_the_whole_tree(spark):
    from pyspark.sql import functions as F

    from quarry.operators import context as cx
    from quarry.operators.tree import tree_lines

    paths = [f"d{i % 11}/e{i % 5}/f{i}.txt" for i in range(600)] + ["a.txt"]
    files = spark.createDataFrame([("p", x, i, f"words of {i}") for i, x in enumerate(paths)] + [("q", "b.txt", 0, "words")],
                                  "project string, path string, ord long, content string")
    asked = [(1, "p", "about f3.txt"), (2, "p", 'x\n  File "/r/a.txt", line 2, in f\n'), (3, "q", "words"), (4, "none", "words")]
    asks = spark.createDataFrame(asked, "query_id long, project string, text string")
    rows = cx.context_document(cx.pack_context(asks, files, 20000), files, asks, whole=True).collect()
    for query, project, _ in asked:
        lines = [r.line for r in sorted(tree_lines(files).where(F.col("project") == project).collect(), key=lambda r: r.parts)]
        doc = ""
        for r in sorted((r for r in rows if r.query_id == query), key=lambda r: (r.section, r.position)):
            assert (r.project, r.start_chars, r.chars) == (project, len(doc), len(r.text))
            doc += r.text
        assert doc.startswith(cx.TREE_HEADER + "\n".join(lines) + "\n\n" + ("--- ACTIVE" if query == 2 else "=== FILE" if project != "none" else ""))
    assert sum(r.query_id == 1 and r.section == 0 for r in rows) > 4  # in blocks, never one string
