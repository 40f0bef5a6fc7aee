"""Catalog entries: archives, recovery and renderings."""

from pyspark.sql import functions as F

from quarry.operators.tree import tree_lines
from quarry.plans import sqlfrag as q
from quarry.plans.q_text import _redact_sql
from quarry.plans.registry import register
from quarry.plans.sql_context import TREE_LINES
from quarry.session import scratch_path, stored
from quarry.sources import archive as ar
from quarry.sources import render as rd
from quarry.sources import tables as t

SMALL_SHARD = 64 * 1024  # several shards per project even on small data


@register("archive_roundtrip", "S5/S6/S7", """
SELECT project, 'ok' AS status, path, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS md5 FROM files_b
""")
def q_archive_roundtrip(spark, sf):
    return _unpacked(ar.pack(t.files_b(spark, sf), shard_bytes=SMALL_SHARD, redact=False))


def _unpacked(packed):
    u = ar.unpack(packed)
    return u.select("project", "status", "path", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("md5"))


@register("archive_redacted", "S5/S6", f"""
SELECT project, 'ok' AS status, path, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS md5 FROM ({_redact_sql([], 'files_b')})
""")
def q_archive_redacted(spark, sf):
    return _unpacked(ar.pack(t.files_b(spark, sf), shard_bytes=SMALL_SHARD))


@register("archive_shards", "S5", f"""
SELECT project, CAST(greatest(ceil(sum(octet_length(encode(content))) / {SMALL_SHARD}), 1) AS BIGINT) AS shards FROM files_b GROUP BY project
""")
def q_archive_shards(spark, sf):
    p = ar.pack(t.files_b(spark, sf), shard_bytes=SMALL_SHARD, redact=False)
    return p.groupBy("project").agg(F.count(F.lit(1)).alias("shards"))


def _marked_docs(spark, sf):
    f = t.files(spark, sf)
    return f.select("project", "ord", F.concat(F.lit("\n--- START_FILE: "), "path", F.lit(" ---\n"), "content",
                                               F.lit("\n--- END_FILE ---\n")).alias("text"))


@register("scrape_marked", "S8", r"""
SELECT project, path, regexp_replace(content, '\s+$', '') AS content FROM files
""")
def q_scrape_marked(spark, sf):
    return ar.scrape_marked(_marked_docs(spark, sf))


@register("force_scrape", "S9", r"""
SELECT project, path, regexp_extract(replace(content, '\', ''), '(?s)^\s*(.*?)\s*$', 1) AS content, true AS plausible FROM files
""")
def q_force_scrape(spark, sf):
    return ar.force_scrape(_marked_docs(spark, sf))


DOC_FILES = 160  # ids that share a snapshot document, by project
PIECE_FILES = 40  # ids that share a piece of its marked text
SNAPSHOT_SHARD = 4096  # so that a document has several shards
_DOC = f"concat_ws('|', project, ord // {DOC_FILES})"


def _snapshot_files(spark, sf):
    f = t.files(spark, sf)
    bucket = F.expr(f"ord DIV {DOC_FILES}")
    return f.withColumn("bucket", bucket).withColumn("doc", F.concat_ws("|", "project", bucket))


def _blocks(f, shard_bytes):
    """(doc, shard, payload, checksum) of every document's shards."""
    return ar.pack(f.select(F.col("doc").alias("project"), "path", "content", "ord"), shard_bytes, redact=False).select(
        F.col("project").alias("doc"), "shard", "payload", "checksum")


def _framed(head, payload):
    return F.concat(F.lit("some text\n" + ar.BLOCK_START + "\n"), head, payload, F.lit("\n" + ar.BLOCK_END + "\nmore"))


def _damaged(blocks, kind):
    """Blocks whole (kind 0), with another checksum (1), without one (2), gone (3), or of a payload that is none (4)."""
    junk = F.base64(F.encode(F.lit("no stream"), "UTF-8"))
    head = F.concat(F.lit("sha256:"), F.col("checksum"), F.lit("\n"))
    other = F.concat(F.lit("sha256:"), F.reverse("checksum"), F.lit("0\n"))
    wrapped = F.regexp_replace("payload", "(.{76})", "$1\n ")
    text = (F.when(kind == 0, _framed(head, wrapped)).when(kind == 1, _framed(other, F.col("payload"))).when(kind == 2, _framed(F.lit(""), F.col("payload")))
            .when(kind == 3, F.lit("nothing here")).otherwise(_framed(F.concat(F.lit("sha256:"), F.sha2(junk, 256), F.lit("\n")), junk)))
    return blocks.withColumn("text", text)


def _bucket_of(doc):
    return F.element_at(F.split(doc, r"\|"), -1).cast("int")


@register("archive_status", "S7", f"""
WITH d AS (SELECT *, {_DOC} AS doc, ord // {DOC_FILES} % 5 AS kind FROM files),
p AS (SELECT unnest(['strict', 'lenient']) AS policy),
seen AS (SELECT policy, doc, path, content, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'legacy' WHEN 3 THEN 'missing' ELSE 'corrupt' END AS status,
                kind IN (0, 2) OR (kind = 1 AND policy = 'lenient') AS opened FROM d, p)
SELECT policy, doc, status, path, md5(content) AS md5 FROM seen WHERE opened
UNION ALL SELECT DISTINCT policy, doc, status, NULL, NULL FROM seen WHERE NOT opened
""")
def q_archive_status(spark, sf):
    """Archives whole, altered, without checksum, gone and broken, under both policies; one block a document."""
    f = _snapshot_files(spark, sf)
    docs = stored(_damaged(_blocks(f, 1 << 40), _bucket_of("doc") % 5).select("doc", "shard", "text"), "damaged")
    both = [ar.unpack(docs, "text", policy, keys=("doc", "shard")).withColumn("policy", F.lit(policy)) for policy in ("strict", "lenient")]
    return both[0].unionByName(both[1]).select("policy", "doc", "status", "path", F.md5("content").alias("md5"))


_LOADED = rf"""
SELECT doc, path, CASE WHEN kind = 1 THEN 'mismatch' ELSE 'ok' END AS status, CASE WHEN kind < 3 THEN 'archive' ELSE 'scrape' END AS source,
       CASE WHEN kind < 3 THEN content ELSE regexp_replace(content, '\s+$', '') END AS content
FROM (SELECT *, {_DOC} AS doc, ord // {DOC_FILES} % 5 AS kind FROM files)
UNION ALL
SELECT DISTINCT {_DOC} || '|x', NULL, CASE WHEN ord // {DOC_FILES} % 2 = 0 THEN 'no_text' ELSE 'no_files' END, NULL, NULL FROM files
"""


@register("load_snapshot", "S10", f"SELECT doc, path, status, source, md5(content) AS md5 FROM ({_LOADED})")
def q_load_snapshot(spark, sf):
    """Documents of many files: several archive shards, pieces of marked text; some without text or files."""
    return _loaded(spark, sf).select("doc", "path", "status", "source", F.md5("content").alias("md5"))


def _loaded(spark, sf):
    f = _snapshot_files(spark, sf)
    docs = _damaged(_blocks(f, SNAPSHOT_SHARD), _bucket_of("doc") % 5).select("doc", F.col("shard").alias("piece"), "text")
    marked = F.concat(F.lit("\n--- START_FILE: "), "path", F.lit(" ---\n"), "content", F.lit("\n--- END_FILE ---\n"))
    piece = F.expr(f"CAST(ord DIV {PIECE_FILES} AS INT)").alias("piece")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "m"))), lambda x: x["m"]), "")
    marked = f.select("doc", piece, "ord", marked.alias("m")).groupBy("doc", "piece").agg(text.alias("text"))
    none = f.select(F.concat_ws("|", "doc", F.lit("x")).alias("doc"), F.lit(0).alias("piece"),
                    F.when(F.col("bucket") % 2 == 0, " \n").otherwise("nothing marked").alias("text")).distinct()
    docs = stored(docs.unionByName(marked).unionByName(none), "snapshots")
    return ar.load_snapshot(docs, key="doc", piece="piece")


@register("snapshot_totals", "S10", f"""
SELECT doc, status, count(path) AS files, CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS chars,
       CAST(coalesce(sum(length(content)), 0) // 4 AS BIGINT) AS tokens FROM ({_LOADED}) GROUP BY doc, status
""")
def q_snapshot_totals(spark, sf):
    return ar.snapshot_totals(_loaded(spark, sf), "doc")


@register("tree_section", "S11", f"""
WITH bf AS (SELECT {_DOC} AS project, path FROM files), {TREE_LINES.strip().replace("FROM files", "FROM bf")}
SELECT project AS doc, '.' || chr(10) || string_agg(prefix || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || p[-1], chr(10) ORDER BY p) AS tree
FROM tw GROUP BY project
""")
def q_tree_section(spark, sf):
    """The rendered tree of each document, found again in its text."""
    f = _snapshot_files(spark, sf).select(F.col("doc").alias("project"), "path", "content", "ord")
    line = F.struct("parts", "line")
    tree = tree_lines(f).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("tree"))
    first = f.groupBy("project").agg(F.min_by("content", "ord").alias("content"))
    text = F.concat(F.lit(rd.TREE_INTRO), F.lit("\n  "), "tree", F.lit("\n\n--- START_FILE: x ---\n"), "content")
    docs = tree.join(first, "project").select(F.col("project").alias("doc"), text.alias("text"))
    return ar.tree_section(docs, key="doc")


@register("markdown_blocks", "S12", f"""
WITH s AS ({_redact_sql([])})
SELECT s.project, f.ord, s.path, '### `' || s.path || '`' || chr(10) || '```' ||
  CASE WHEN lower({q.suffix('s.path')}) = '' THEN 'text' ELSE substr(lower({q.suffix('s.path')}), 2) END || chr(10) || s.content || chr(10) || '```' || chr(10) AS block
FROM s JOIN files f USING (project, path)
""")
def q_markdown_blocks(spark, sf):
    return rd.markdown_blocks(t.files(spark, sf))


@register("markdown_document", "S12")
def q_markdown_document(spark, sf):
    return rd.markdown_document(t.files(spark, sf)).select("project", "sec", "k1", F.array_join("k2", "/").alias("k2"), "text")


@register("marked_chunks", "S13", f"""
WITH s AS (SELECT project, path, f.ord, replace(regexp_replace(r.content, '[\\x{{10000}}-\\x{{10FFFF}}\\x{{2600}}-\\x{{27BF}}\\x{{FE00}}-\\x{{FE0F}}]', '?', 'g'), chr(0), '') AS clean
           FROM ({_redact_sql([])}) r JOIN files f USING (project, path)),
n AS (SELECT *, CAST(greatest(ceil(length(clean) / 10000), 1) AS BIGINT) AS n FROM s)
SELECT project, ord, CAST(0 AS BIGINT) AS part, chr(10) || '--- START_FILE: ' || path || ' ---' || chr(10) AS text FROM n
UNION ALL
SELECT project, ord, i + 1 AS part, substr(clean, CAST(i * 10000 + 1 AS BIGINT), 10000) AS text FROM (SELECT *, unnest(range(0, n)) AS i FROM n)
UNION ALL
SELECT project, ord, n + 1 AS part, chr(10) || '--- END_FILE ---' || chr(10) AS text FROM n
""")
def q_marked_chunks(spark, sf):
    return rd.marked_chunks(t.files(spark, sf))


@register("batch_export", "S14", rf"""
WITH p AS (SELECT DISTINCT project FROM files UNION SELECT 'src_missing'),
r AS ({_redact_sql([], 'files_b')}),
w AS (SELECT project, CAST(sum(length(replace(regexp_replace(content, '[\x{{10000}}-\x{{10FFFF}}\x{{2600}}-\x{{27BF}}\x{{FE00}}-\x{{FE0F}}]', '?', 'g'), chr(0), ''))
        + greatest(ceil(length(content) / 10000), 1) + length(path) + length('--- START_FILE:  ---') + 3 + length('--- END_FILE ---') + 3) AS BIGINT) AS written
      FROM r GROUP BY project)
SELECT p.project, CASE WHEN count(f.path) = 0 THEN 'empty' ELSE 'ok' END AS status, count(f.path) AS files,
       CAST(coalesce(sum(length(f.content)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(length(f.content)), 0) // 4 AS BIGINT) AS tokens,
       coalesce(max(w.written), 0) AS written
FROM p LEFT JOIN files_b f USING (project) LEFT JOIN w USING (project) GROUP BY p.project
""")
def q_batch_export(spark, sf):
    f = t.files(spark, sf)
    projects = f.select("project").distinct().unionByName(spark.range(1).select(F.lit("src_missing").alias("project")))
    out = scratch_path(spark, "export")
    status = rd.batch_export(t.files_b(spark, sf), projects, out)
    written = rd.exported(spark, out).withColumnRenamed("chars", "written")
    return status.join(written, "project", "left").fillna({"written": 0})
