"""Catalog entries: streaming (T1-T3). Inputs are written by Spark from the
given tables into the checkpoint folder, then consumed as streams."""

from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import store as sto
from quarry.sources import tables as t
from quarry.streaming import sync as st


@register("stream_sync", "T1", """
WITH s AS (SELECT project, path, md5(content) AS h FROM files_a), u AS (SELECT project, path, md5(content) AS h, ord FROM files_b)
SELECT project, path, coalesce(u.h, s.h) AS file_hash FROM s FULL OUTER JOIN u USING (project, path) WHERE u.ord IS NULL OR u.ord % 9 <> 4
UNION ALL SELECT '007', path, md5(content) FROM files WHERE ord % 25 = 0
""")
def q_stream_sync(spark, sf):
    """Two streams onto a store that holds rows already: new versions, deletes, then late and repeated ones."""
    src, other, root = (scratch_path(spark, x) for x in ("src", "other", "store"))
    ck = [scratch_path(spark, "ck") for _ in range(2)]
    base = sto.as_changes(t.files_a(spark, sf), "2024-01-01 00:00:00", 1, "base")
    sto.append_changes(base, root, "base")
    held = base.select("project", "path", "version", "file_hash")

    def versions(files, version, deleted=False):
        return files.select("project", "path", "ord", "content").withColumns({"version": F.lit(version).cast("long"), "deleted": F.lit(deleted)})

    new = t.files_b(spark, sf)
    versions(new, 3).write.parquet(src)
    versions(new.where(F.col("ord") % 9 == 4).withColumn("content", F.lit(None).cast("string")), 4, True).write.mode("append").parquet(src)
    more = t.files(spark, sf).where(F.col("ord") % 25 == 0).withColumn("project", F.lit("007"))
    versions(more.dropDuplicates(["path"]), 1).write.parquet(other)
    now = "2024-01-02 00:00:00"
    st.continuous_sync(spark, src, root, ck[0], now=now, held=held).awaitTermination()
    st.continuous_sync(spark, other, root, ck[1], now=now).awaitTermination()
    # an older version of every file arrives late, and the newest ones once more
    versions(t.files_a(spark, sf).withColumn("content", F.lit("late")), 1).write.mode("append").parquet(src)
    versions(new, 3).write.mode("append").parquet(src)
    st.continuous_sync(spark, src, root, ck[0], now=now, held=held).awaitTermination()
    return sto.latest(spark, root).select("project", "path", "file_hash")


@register("stream_tool_ingest", "T2", """
WITH fl AS (SELECT name, CASE WHEN json_valid(content) AND json_type(content) = 'ARRAY'
  THEN array_to_string(list_filter(list_transform(CAST(content AS JSON[]), lambda b: CASE WHEN json_type(b) = 'OBJECT' THEN b->>'text' ELSE b->>'$' END), lambda x: x IS NOT NULL), chr(10))
  ELSE content END AS text FROM tool_results)
SELECT 'mcp://' || name AS path, CAST(length(text) AS INTEGER) AS file_size FROM fl WHERE contains(name, '__') AND length(text) >= 100
""")
def q_stream_tool_ingest(spark, sf):
    src, root, ck = scratch_path(spark, "tools"), scratch_path(spark, "store"), scratch_path(spark, "ck")
    t.tool_results(spark, sf).write.parquet(src)
    st.tool_ingest(spark, src, root, ck, now="2024-01-01 00:00:00").awaitTermination()
    return sto.latest(spark, root).select("path", "file_size")


_ASSEMBLED = """
SELECT message_id, string_agg(chunk, '' ORDER BY seq) AS text FROM chunks GROUP BY message_id
HAVING max(CASE WHEN is_last THEN seq END) IS NOT NULL AND count(*) = max(CASE WHEN is_last THEN seq END) + 1
   AND length(string_agg(chunk, '' ORDER BY seq)) > 0
"""


@register("assemble_chunks", "T3", _ASSEMBLED)
def q_assemble_chunks(spark, sf):
    return st.assemble_chunks(t.chunks(spark, sf))


@register("assemble_chunks_stream", "T3", """
WITH c AS (SELECT *, seq = 0 AND message_id % 7 = 3 AND NOT is_last AS lost FROM chunks),
m AS (SELECT message_id, string_agg(chunk, '' ORDER BY seq) AS text, count(*) AS n, bool_or(lost) AS lost FROM c GROUP BY message_id)
SELECT message_id, CASE WHEN NOT lost THEN text END AS text, CASE WHEN lost THEN n - 1 ELSE n END AS received, CASE WHEN lost THEN 1 ELSE 0 END AS missing
FROM m WHERE lost OR length(text) > 0
""")
def q_assemble_chunks_stream(spark, sf):
    """Pieces in two deliveries, some twice, some never; a last message far ahead lets the others expire."""
    src, ck = scratch_path(spark, "chunks"), scratch_path(spark, "ck")
    c = t.chunks(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") % 60))
    c = c.where(~((F.col("seq") == 0) & (F.col("message_id") % 7 == 3) & ~F.col("is_last")))
    c.where((F.col("seq") % 3 != 1) | F.col("is_last")).write.parquet(src)
    c.where(F.col("seq") % 3 != 2).write.mode("append").parquet(src)
    ahead = spark.range(1).select(F.lit(-1).cast("long").alias("message_id"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("chunk"),
                                  F.lit(True).alias("is_last"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"))
    out = scratch_path(spark, "assembled")

    def run():
        stream = spark.readStream.schema("message_id long, seq long, chunk string, is_last boolean, ts timestamp").parquet(src)
        with st.state_store(spark):
            st.assemble_chunks_stream(stream).writeStream.format("parquet").option("path", out).option(
                "checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    ahead.write.mode("append").parquet(src)
    run()
    return spark.read.schema("message_id long, text string, received long, missing long").parquet(out)
