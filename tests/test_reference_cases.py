"""The reference's own test cases, restated as data (vector thresholds, path dedup)."""

from pyspark.sql import functions as F

from quarry.operators import registry as rg
from quarry.operators import responses as rs
from quarry.operators import vectors as vx
from quarry.sources import archive as ar

VECS = [("apple.txt", [1.0, 0.0]), ("apply.txt", [0.9, 0.4]), ("orange.txt", [0.0, 1.0])]


def _corpus(spark):
    return spark.createDataFrame(VECS, "id string, embedding array<double>")


def _probe(spark):
    return spark.createDataFrame([("q", [1.0, 0.0])], "probe_id string, embedding array<double>")


def _ids(df, order="rank"):
    return [r["id"] for r in df.orderBy(order).collect()]


def test_search_thresholds(spark):
    c, p = _corpus(spark), _probe(spark)
    assert len(_ids(vx.search(p, c, 10, 0.0))) == 3
    assert _ids(vx.search(p, c, 10, 0.5)) == ["apple.txt", "apply.txt"]
    assert _ids(vx.search(p, c, 10, 0.95)) == ["apple.txt"]


def test_related_excludes_self(spark):
    c = _corpus(spark)
    seeds = spark.createDataFrame([("apple.txt",)], "id string")
    assert _ids(vx.related(seeds, c, 5, 0.5)) == ["apply.txt"]
    assert _ids(vx.related(seeds, c, 5, 0.0)) == ["apply.txt", "orange.txt"]
    unknown = spark.createDataFrame([("pear.txt",)], "id string")
    assert vx.related(unknown, c, 5, 0.0).count() == 0


def test_add_without_duplicates(spark):
    existing = spark.createDataFrame([("p", "src/main.py")], "project string, path string")
    root = "/project/"

    def add(paths, ci=False):
        inc = spark.createDataFrame([("p", x, i) for i, x in enumerate(paths)], "project string, path string, ord long")
        return [r["path"] for r in rg.add_unique(existing, inc, root, case_insensitive=ci).collect()]

    # root is /project/p/: first add of a new file stores the relative path
    assert add(["/project/p/src/util.py"]) == ["src/util.py"]
    assert add(["/project/p/src/main.py"]) == []  # already present
    assert add(["/project/p/SRC/MAIN.PY"], ci=True) == []  # case-insensitive option
    assert add(["/project/p/SRC/MAIN.PY"], ci=False) == ["SRC/MAIN.PY"]
    assert add(["/project/p/src/../src/main.py"]) == []  # normalised alias
    assert add(["/elsewhere/x.py"]) == ["/elsewhere/x.py"]  # outside the root stays absolute


def test_selection_reconcile(spark):
    files = spark.createDataFrame([("p", "src/main.py")], "project string, path string")
    chosen = spark.createDataFrame([(1, "p", "/project/root/p/src/main.py"), (2, "p", "src/main.py"), (3, "p", "nope.py")],
                                   "id int, project string, path string")
    got = sorted(r["id"] for r in rs.reconcile_selection(files, chosen, "/project/root/").collect())
    assert got == [1, 2]


def test_snapshot_in_several_pieces(spark):
    """Whole if every block decodes, scraped if one does not; an altered checksum is only reported."""
    files = spark.createDataFrame([(d, f"f{i}.txt", f"{d} content {i} \n", i) for d in "abc" for i in range(12)], "project string, path string, content string, ord long")
    packed = ar.pack(files, shard_bytes=40, redact=False)
    assert packed.groupBy("project").count().agg(F.min("count")).first()[0] > 2
    first = packed.groupBy("project").agg(F.min("shard").alias("shard")).withColumn("first", F.lit(True))
    j = packed.join(first, ["project", "shard"], "left")
    block = (F.when(F.col("first") & (F.col("project") == "b"), F.regexp_replace("block", "sha256:..", "sha256:zz"))
             .when(F.col("first") & (F.col("project") == "c"), F.regexp_replace("block", r"(?s)\n([^\n]+)[^\n]\n--- R", "\n$1\n--- R")).otherwise(F.col("block")))
    marked = files.select("project", (F.col("ord") + 100).cast("int").alias("piece"), F.concat(F.lit("\n--- START_FILE: "), "path", F.lit(" ---\n"), "content", F.lit("\n--- END_FILE ---\n")).alias("text"))
    old = marked.withColumn("piece", F.lit(1)).withColumn("text", F.replace("text", F.lit("content"), F.lit("older")))  # a later piece wins
    docs = j.select("project", F.col("shard").alias("piece"), block.alias("text")).unionByName(marked).unionByName(old)
    got = {(r.project, r.path): (r.content, r.source, r.status) for r in ar.load_snapshot(docs, piece="piece").collect()}
    for d, source, status in (("a", "archive", "ok"), ("b", "archive", "mismatch"), ("c", "scrape", "ok")):
        for i in range(12):
            want = f"{d} content {i} \n" if source == "archive" else f"{d} content {i}"
            assert got[d, f"f{i}.txt"] == (want, source, status)
    assert len(got) == 36


def test_broken_blocks_never_end_the_job(spark):
    """Wrong length, other characters, empty payload, no line after the checksum, no JSON."""
    import base64
    import zlib

    def block(body):
        return f"{ar.BLOCK_START}\n{body}\n{ar.BLOCK_END}"

    z = base64.b64encode(zlib.compress(b'{"x": "y"}')).decode()
    not_json = base64.b64encode(zlib.compress(b"[1")).decode()
    odd = "-" + z[:8] + "*" + z[8:]
    rows = [("odd", block(odd), "legacy"), ("short", block(z[:-1] if z[-1] != "=" else z[:-2]), "corrupt"), ("empty", block(""), "corrupt"),
            ("line", block("sha256:abc"), "mismatch"), ("json", block(not_json), "corrupt"), ("null", None, "missing")]
    docs = spark.createDataFrame([(k, 0, x) for k, x, _ in rows], "project string, shard int, block string")
    got = {r.project: r.status for r in ar.unpack(docs).collect()}
    for k, _, want in rows:
        assert got[k] == want, (k, got)
    assert {r.project: r.status for r in ar.load_snapshot(docs.withColumnRenamed("block", "text")).collect()} == {
        "odd": "ok", "short": "no_files", "empty": "no_files", "line": "no_files", "json": "no_files", "null": "no_text"}
