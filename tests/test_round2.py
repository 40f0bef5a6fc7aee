"""Cases of faults that were mended: scan, store, redaction, search blocks, moves, selections."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import changes as ch
from quarry.operators import context as cx
from quarry.operators import memory as mem
from quarry.operators import registry as rg
from quarry.operators import responses as rs
from quarry.operators import secrets as se
from quarry.operators import ivf
from quarry.operators import vectors as vx
from quarry.operators.tree import tree_lines, tree_rows
from quarry.session import scratch_path
from quarry.sources import gather as ga
from quarry.sources import store as sto
from quarry.streaming import sync as st

FILES = "project string, path string, content string"


def test_scan_sees_hidden_names_and_never_enters_ignored_folders(spark, tmp_path):
    names = ["__init__.py", ".env", "_private/x.py", ".github/ci.yml", "a/b/c.txt", "node_modules/deep/y.js", "a/bad.bin"]
    for n in names:
        os.makedirs((tmp_path / n).parent, exist_ok=True)
        (tmp_path / n).write_bytes(b"\xff\xfe" if n.endswith(".bin") else n.encode())
    (tmp_path / "node_modules").chmod(0o755)
    got = {r["rel"]: r["text"] for r in ga.read_tree(spark, str(tmp_path), ["node_modules/"]).collect()}
    want = {n: n for n in names if not n.startswith("node_modules")} | {"a/bad.bin": "Error: Could not read file"}
    assert got == want
    assert set(r["rel"] for r in ga.read_tree(spark, str(tmp_path), ["node_modules/"], [".py"]).collect()) == {"__init__.py", "_private/x.py"}


def _rows(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_redaction_over_all_files(spark):
    value = "a1b2c3d4e5f6"
    files = _rows(spark, [("p", "a", f'token = "{value}"'), ("p", "b", f"see {value} here"), ("q", "c", f'secret = "{value}xyz"'), ("q", "d", 'token =\n"zzzzzzzz99"'), ("q", "n", None)])
    got = {r.path: r.content for r in se.redact(files).collect()}
    assert got == {"a": f'token = "{se.REDACTION}"', "b": f"see {se.REDACTION} here", "c": f'secret = "{se.REDACTION}"', "d": 'token =\n"zzzzzzzz99"', "n": None}
    assert {r.value for r in se.scan(files).collect()} == {value, value + "xyz"}
    assert se.redact(files, [value, value + "xyz"]).where("path = 'b'").first().content == f"see {value} here"


def test_probe_blocks(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, [float(i % 3 == k) + 0.01 * i for k in range(3)]) for i in range(10)], "id long, embedding array<double>")
    probes = spark.range(200_001).select(F.col("id").alias("probe_id"), F.array(*[(F.col("id") % 3 == k).cast("double") for k in range(3)]).alias("embedding"))
    got = vx.search(probes, corpus, 1, 0.0)
    assert got.count() == 200_001
    assert {(r.probe_id % 3, r.id) for r in got.where("probe_id < 3 OR probe_id > 199990").collect()} == {(0, 0), (1, 1), (2, 2)}


def test_overlapping_moves(spark):
    items = spark.createDataFrame([("p", x, i) for i, x in enumerate("abcd")], "project string, path string, ord long")
    req = spark.createDataFrame([("p", "b", "up"), ("p", "b", "down"), ("p", "c", "up"), ("p", "d", "up"), ("p", "a", "up")], "project string, path string, direction string")
    got = [r.path for r in rg.move_item(items, req).orderBy("ord").collect()]
    assert got == ["b", "a", "d", "c"] or sorted(got) == ["a", "b", "c", "d"]
    many = spark.createDataFrame([("p", f"f{i}", i * 7) for i in range(50)], "project string, path string, ord long")
    n = {r.path: (r.prev and r.prev.p, r.next and r.next.p) for r in rg.neighbours(many, bucket=20).collect()}
    assert n == {f"f{i}": (f"f{i - 1}" if i else None, f"f{i + 1}" if i < 49 else None) for i in range(50)}


def test_selection_element_types(spark):
    texts = ['["a", "b"]', '["a", 1]', '[{"a": 1}]', "[]", '["a", null]', "no", '```json\n["x"]\n```']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.status, r.paths) for r in rs.parse_selection(df).collect()}
    assert [got[i][0] for i in range(7)] == ["ok", "invalid", "invalid", "ok", "invalid", "invalid", "ok"]
    assert got[0][1] == ["a", "b"] and got[6][1] == ["x"]


def test_patches_stay_in_their_project(spark):
    files = spark.createDataFrame([("p", "README.md", 0, "old"), ("q", "README.md", 0, "old")], "project string, path string, ord long, content string")
    patch = spark.createDataFrame([("p", 1, 1, 0, 0, "README.md", "new", True)], "project string, conv_id long, turn long, p1 long, p2 long, file string, code string, safe boolean")
    got = {(r.project, r.path): r.content for r in rs.apply_patches(files, patch).collect()}
    assert got == {("p", "README.md"): "new", ("p", "README.md.bak"): "old", ("q", "README.md"): "old"}


def test_unicode_spaces_and_null_content(spark):
    files = spark.createDataFrame([("p", "x.txt", 0, "bonjour le monde"), ("p", "n.txt", 1, None)], "project string, path string, ord long, content string")
    q = spark.createDataFrame([(1, "p", "bonjour\u00a0monde"), (2, "p", "bonjour\u3000monde"), (3, "p", "n.txt")], "query_id long, project string, text string")
    got = {(r.query_id, r.path): (r.score, r.tokens) for r in cx.relevance(q, files).collect()}
    assert got == {(1, "x.txt"): (2, 4), (2, "x.txt"): (2, 4), (3, "n.txt"): (30 + 20, None)} or got == {(1, "x.txt"): (2, 4), (2, "x.txt"): (2, 4), (3, "n.txt"): (50, None)}
    both = ch.compare_snapshots(files.select("project", "path", "content"), files.select("project", "path", "content")).collect()
    assert both == []


def test_priority_files_in_frame_order(spark):
    files = spark.createDataFrame([("p", "z/one.py", 0, "1"), ("p", "y/two.py", 1, "2")], "project string, path string, ord long, content string")
    text = 'Traceback\n  File "/r/y/two.py", line 7, in f\n  File "/r/z/one.py", line 3, in g\n'
    q = spark.createDataFrame([(1, "p", text)], "query_id long, project string, text string")
    rows = cx.context_document(cx.pack_context(q, files, 1000), files, q).collect()
    tree = "\n".join(r.line for r in sorted(tree_rows(files).collect(), key=lambda r: r.position))
    doc = ""
    for r in sorted(rows, key=lambda r: (r.section, r.position)):
        text = r.text if r.section else r.text + tree + "\n\n"
        assert (r.start_chars, r.chars) == (len(doc), len(text))
        doc += text
    assert doc.startswith("PROJECT ARCHITECTURE:\n.\n") and "!!! CRASH DETECTED IN y/two.py AT LINE 7 !!!\n=== FILE: y/two.py ===\n2\n\n" in doc
    assert doc.index("FILE: y/two.py") < doc.index("FILE: z/one.py")


def test_tree_rows_over_many_ranges(spark):
    paths = [f"d{i % 13}/e{i % 7}/f{i}.txt" for i in range(400)] + ["a.txt"]
    files = spark.createDataFrame([(p, x) for p in ("p", "q") for x in (paths if p == "p" else paths[:3])], "project string, path string")
    lines = {p: [r.line for r in sorted(tree_lines(files).where(F.col("project") == p).collect(), key=lambda r: r.parts)] for p in ("p", "q")}
    for p, want in lines.items():
        got = sorted(tree_rows(files).where(F.col("project") == p).collect(), key=lambda r: r.position)
        assert [r.line for r in got] == want and [r.position for r in got] == list(range(len(want)))
        assert [r.start_chars for r in got] == [sum(len(x) + 1 for x in want[:i]) for i in range(len(want))]
    assert tree_rows(files.limit(0)).count() == 0


def test_long_conversation_in_blocks(spark):
    m = spark.createDataFrame([(1, i, "user", "x" * (4 * (i % 5 + 1))) for i in range(600)], "conv_id long, turn long, role string, text string")
    kept = sorted(r.turn for r in mem.trim_history(m, max_tokens=500, block=64).where("keep").collect())
    total, want = 0, []
    for i in reversed(range(600)):
        total += i % 5 + 1
        if total <= 500 or 600 - i <= mem.PRESERVE_RECENT:
            want.append(i)
    assert kept == sorted(want)


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from quarry import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_approximate_search_near_the_threshold(spark, tmp_path):
    """Probes with few neighbours, all just above min_score, are found too."""
    import numpy as np

    rng = np.random.default_rng(11)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    probes = unit(rng.standard_normal((40, 64)))
    rows = []
    for k, p in enumerate(probes):
        for j in range(10):
            other = rng.standard_normal(64)
            other = unit(other - (other @ p) * p)
            c = 0.5 + 0.02 * rng.random()
            rows.append((k * 10 + j, (c * p + (1 - c * c) ** 0.5 * other).tolist()))
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(probes)], "probe_id long, embedding array<double>")
    exact = vx.search(asked, corpus, 10, 0.5)
    ivf.build(corpus, str(tmp_path / "ivf"))
    share = [r.recall for r in vx.recall(ivf.search(asked, str(tmp_path / "ivf"), 10, 0.5), exact).collect()]
    assert len(share) == 40 and np.mean(share) > 0.95 and min(share) >= 0.7
