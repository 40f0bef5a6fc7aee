"""Unit cases for archives, rules, diffs, traces and guards."""

from pyspark.sql import functions as F

from quarry.functions import wildcard as W
from quarry.operators import changes as ch
from quarry.operators import context as cx
from quarry.operators import filters as fl
from quarry.sources import archive as ar

FILES = [("p", "a.py", 0, "print('a')\n"), ("p", "dir/b.md", 1, "# b ✅ ünï"), ("p", "a.py", 2, "print('a2')\n")]
SCHEMA = "project string, path string, ord long, content string"


def test_archive_roundtrip_and_tamper(spark):
    f = spark.createDataFrame(FILES, SCHEMA)
    packed = ar.pack(f)
    rows = {r["path"]: r["content"] for r in ar.unpack(packed).collect()}
    assert rows == {"a.py": "print('a2')\n", "dir/b.md": "# b ✅ ünï"}  # last duplicate wins
    block = packed.first()["block"]
    body = block.split("\n")
    tampered = "\n".join(body[:2] + [body[2][:-6] + ("A" if body[2][-6] != "A" else "B") + body[2][-5:]] + body[3:])
    wrapped = "\n".join(body[:2] + [body[2][i:i + 50] for i in range(0, len(body[2]), 50)] + body[3:])
    legacy = "\n".join([body[0], body[2], body[3]])
    docs = spark.createDataFrame([("t", 0, tampered), ("w", 0, wrapped), ("l", 0, legacy), ("m", 0, "no block here")],
                                 "project string, shard int, block string")
    st = {r["project"]: r["status"] for r in ar.unpack(docs).collect()}
    assert st == {"t": "mismatch", "w": "ok", "l": "legacy", "m": "missing"}
    lenient = ar.unpack(docs.where("project = 't'"), policy="lenient").collect()
    assert all(r["status"] in ("mismatch", "corrupt") for r in lenient)


def test_ignore_rules(spark):
    paths = ["build/x.py", "build/keep.txt", "src/a.pyc", "src/a.py", "de/x/y.json", "en/y.json", ".git/config", "a/b/c.log"]
    df = spark.createDataFrame([("p", x) for x in paths], "project string, path string")
    kept = {r["path"] for r in fl.ignore_filter(df, ["build/", "!build/keep.txt", "*.pyc", "*.json", "!de/**/*.json", "/a/**"]).collect()}
    assert kept == {"src/a.py", "de/x/y.json"}


def test_compile_rule_shapes():
    assert W.compile_rule("# c") is None
    assert W.compile_rule("!x").ignore is False
    assert W.compile_rule("/docs").regex.startswith("^docs")


def test_file_diffs(spark):
    frame = lambda rows: spark.createDataFrame([("p", *r) for r in rows], "project string, path string, content string")
    old = frame([("same", "a"), ("new", ""), ("gone", "x"), ("f", "a\nb\n"), ("null", None)])
    got = {r["path"]: r["diff"] for r in ch.file_diffs(old, frame([("same", "a"), ("new", "x"), ("gone", None), ("f", "a\nc\n"), ("null", None)])).collect()}
    d = got.pop("f")
    assert got == {"new": "(New File: new)", "gone": "(Deleted File: gone)"}
    assert d.splitlines()[:2] == ["--- SNAPSHOT/f", "+++ CURRENT/f"] and "-b" in d and "+c" in d


def test_stack_trace_tiers(spark):
    files = spark.createDataFrame([("p", "src/app/main.py", 0), ("p", "lib/main.py", 1), ("p", "util.py", 2), ("p", "x/util.py", 3)],
                                  "project string, path string, ord long")
    text = ('Traceback:\n  File "/home/u/proj/src/app/main.py", line 3, in f\n  File "C:\\\\w\\\\util.py", line 9, in g\n'
            '  File "/other/main.py", line 4, in h\n')
    tr = spark.createDataFrame([(1, "p", text)], "trace_id long, project string, text string")
    got = [r["path"] for r in cx.stack_trace_files(tr, files, "trace_id", "project").orderBy("first_pos").collect()]
    # suffix match, then base-name fallback (first file in order), dedup keeps first frame
    assert got == ["src/app/main.py", "util.py"]
    lines = {r["bn"]: r["crash_line"] for r in cx.crash_lines(tr.select("trace_id", "text")).collect()}
    assert lines["main.py"] == 4 and lines["util.py"] == 9


def test_unsafe_paths(spark):
    df = spark.createDataFrame([("../etc/passwd",), ("/abs",), ("a/../b",), ("ok/x.py",), ("\\\\x",)], "path string")
    r = {x["path"]: (x["restore_safe"], x["patch_safe"]) for x in fl.unsafe_paths(df).collect()}
    assert r["../etc/passwd"] == (False, False)
    assert r["/abs"] == (False, False)
    assert r["a/../b"] == (True, False)
    assert r["ok/x.py"] == (True, True)


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
