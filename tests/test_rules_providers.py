"""Rules as data against the rule compiler, and the provider chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import wildcard as W
from quarry.operators import filters as fl
from quarry.operators import providers as pr
from quarry.operators import vectors as vx

PATHS = [".git/x", "a.py", "a.pyc", "build/b/c.py", "build/keep.py", "src/build/x", "src/a.json", "src/b/a.json", "docs/a.md", "docs/deep/a.md", "README"]
RULES = {
    "p": ["*.pyc", "build/", "!build/keep.py", "# note", "", "docs/*.md"],
    "q": ["*", "!src/", "!src/**", "src/b/"],
    "r": ["!a.pyc", "*.pyc", "!a.pyc"],
}


def test_every_project_by_its_own_list(spark):
    projects = [*RULES, "none"]
    files = spark.createDataFrame([(p, x) for p in projects for x in PATHS], "project string, path string")
    rules = spark.createDataFrame([(p, k, line) for p, lines in RULES.items() for k, line in enumerate(lines)], "project string, position int, line string")
    for prune, always in ((True, W.ALWAYS_IGNORED), (False, ())):
        got = {(r.project, r.path) for r in fl.project_ignore_filter(files, rules, always, prune).collect()}
        want = set()
        for p in projects:
            mine = files.where(F.col("project") == p)
            kept = fl.ignore_filter(mine, RULES.get(p, []), always) if prune else fl.exclude_filter(mine, RULES.get(p, []))
            want |= {(r.project, r.path) for r in kept.collect()}
        assert got == want


def stubs():
    """Providers as local functions, which travel to the workers by value."""

    def broken():
        raise OSError

    def even():
        def embed(texts):
            if any(len(t) > 6 for t in texts):
                raise RuntimeError
            return [[1.0, float(len(t))] if len(t) % 2 == 0 else None for t in texts]

        return embed

    def wrong_count():
        return lambda texts: []

    return [("broken", broken), ("even", even), ("odd", wrong_count)]


def test_chain(spark):
    rows = [("p", "a", "xx"), ("p", "b", "xxx"), ("p", "c", "far too long"), ("p", "d", None), ("p", "e", "")]
    files = spark.createDataFrame(rows, "project string, path string, content string").coalesce(1)
    got = {r.path: (r.embedding, r.provider, r.failures) for r in pr.embed_files(files, stubs()).collect()}
    assert got["a"] == ([1.0, 2.0], "even", ["broken: OSError"])
    assert got["b"] == (None, None, ["broken: OSError", "even: no vector", "odd: 0 vectors for 1 texts"])
    assert got["c"] == (None, None, ["broken: OSError", "even: RuntimeError", "odd: 0 vectors for 1 texts"])
    assert got["d"] == (None, None, []) and got["e"][1] == "even"


def test_chain_plugs_into_the_index(spark):
    files = spark.createDataFrame([("p", "a", "x" * 3), ("p", "b", "y")], "project string, path string, content string")

    def ones():
        return lambda texts: [[3.0, 4.0] if "yy" not in t else None for t in texts]

    index = {r.path: r.embedding for r in vx.build_index(files, pr.only_vectors([("ones", ones)])).collect()}
    assert index == {"a": [0.6, 0.8], "b": [0.6, 0.8]}
