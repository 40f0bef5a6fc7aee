"""Keyed state of the streams, change files, and event-time assembly of chunks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.sources import store as sto
from quarry.streaming import sync as st

CHUNKS = "message_id long, seq long, chunk string, is_last boolean, ts timestamp"


def put(spark, path, rows, schema, n=1):
    spark.createDataFrame(rows, schema).coalesce(n).write.mode("append").parquet(path)


def changes_of(spark, root, stream):
    return spark.read.schema(sto.CHANGE_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/{stream}")


def test_versions_deletes_replays_and_two_streams(spark, tmp_path):
    src, other, root = (str(tmp_path / x) for x in ("src", "other", "store"))
    base = spark.createDataFrame([("p", "same", "1"), ("p", "old", "2"), ("p", "gone", "3"), ("p", "null", None)], "project string, path string, content string")
    base = sto.as_changes(base, "2024-01-01", 1, "base")
    sto.append_changes(base, root, "base")
    held = base.select("project", "path", "version", "file_hash")
    put(spark, src, [("p", "same", 0, "1", 2, False), ("p", "old", 0, "late", 2, False), ("p", "old", 1, "new", 5, False), ("p", "gone", 0, None, 3, True),
                     ("p", "never", 0, None, 3, True), ("p", "null", 0, None, 2, None), ("p", "tie", 2, "b", 2, False), ("p", "tie", 1, "a", 2, False)], st.FILES_SCHEMA)
    put(spark, other, [("p", "other", 0, "x", 1, False), ("p", "old", 0, "older", 4, False)], st.FILES_SCHEMA)
    st.continuous_sync(spark, src, root, str(tmp_path / "ck1"), now="2024-01-02", held=held).awaitTermination()
    first = sorted((r.path, r.deleted) for r in changes_of(spark, root, "ck1").collect())
    assert first == [("gone", True), ("old", False), ("tie", False)]  # unchanged files are not written
    st.continuous_sync(spark, other, root, str(tmp_path / "ck2"), now="2024-01-02").awaitTermination()
    put(spark, src, [("p", "old", 1, "new", 5, False), ("p", "old", 0, "late", 3, False), ("p", "gone", 0, "back", 2, False), ("p", "same", 0, "1", 6, False),
                     ("p", "tie", 0, "c", 3, False)], st.FILES_SCHEMA)
    st.continuous_sync(spark, src, root, str(tmp_path / "ck1"), now="2024-01-03", held=held).awaitTermination()
    assert changes_of(spark, root, "ck1").count() == 4  # only the newer "tie" was added
    got = {r.path: r.content for r in sto.latest(spark, root).collect()}
    assert got == {"same": "1", "old": "new", "null": None, "tie": "c", "other": "x"}
    assert {r.path: r.content for r in sto.latest(spark, root, 1).collect()} == {"same": "1", "old": "2", "gone": "3", "null": None, "other": "x"}
    sto.clear_changes(spark, root, 9)
    assert sto.latest(spark, root).count() == 0
    assert spark.conf.get(st._PROVIDER, None) != st._ROCKS


def test_a_batch_run_again_replaces_its_own_files(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = sto.as_changes(spark.createDataFrame([("p", "a", "1")], "project string, path string, content string"), "2024-01-01", 1, "s")
    for _ in range(2):
        sto.append_changes(rows, root, "s", 7)
    assert changes_of(spark, root, "s").count() == 1 and sto.latest(spark, root).count() == 1


def test_chunks_late_repeated_and_missing(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))

    def run():
        stream = spark.readStream.schema(CHUNKS).parquet(src)
        with st.state_store(spark):
            st.assemble_chunks_stream(stream, "10 seconds", 60_000).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema("message_id long, text string, received long, missing long").parquet(out)
        return sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])

    def at(*rows):
        spark.createDataFrame([(m, s, c, last, t) for m, s, c, last, t in rows], CHUNKS.replace("timestamp", "long")).withColumn(
            "ts", F.timestamp_seconds("ts")).write.mode("append").parquet(src)

    at((1, 1, "b", True, 1000), (2, 0, "x", False, 1000), (3, 0, "", True, 1000), (4, 0, "q", False, 1000), (5, 2, "z", True, 1000), (5, 0, "a", False, 1000))
    assert run() == []
    at((1, 0, "a", False, 1005), (1, 0, "A", False, 1005), (2, 0, "x", False, 1006), (2, 1, None, True, 1004))
    assert run() == [(1, "ab", 2, 0), (2, "x", 2, 0)]
    at((1, 1, "b", True, 1010), (9, 0, "far", True, 5000))  # a piece of a whole message once more
    assert run() == [(1, "ab", 2, 0), (2, "x", 2, 0), (4, None, 1, None), (5, None, 2, 1), (9, "far", 1, 0)]
    at((5, 1, "late", False, 1001))  # behind the watermark: dropped
    assert len(run()) == 5


@pytest.mark.parametrize("setting", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_state_store_setting_is_put_back(spark, setting):
    before = spark.conf.get(st._PROVIDER, None)
    if setting:
        spark.conf.set(st._PROVIDER, setting)
    with st.state_store(spark):
        assert spark.conf.get(st._PROVIDER) == st._ROCKS
    assert spark.conf.get(st._PROVIDER, None) == (setting or before)
