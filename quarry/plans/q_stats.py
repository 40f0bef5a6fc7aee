"""Catalog entries: aggregations, conversation memory and scalar functions."""

from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as X
from quarry.operators import memory as mem
from quarry.operators import named as nm
from quarry.operators import stats as st
from quarry.operators import tree as tr
from quarry.plans import sqlfrag as q
from quarry.plans.registry import register
from quarry.plans.sql_context import TREE_LINES
from quarry.sources import tables as t

TRIM_TOKENS = 400
LB = st.LINE_BREAK_RX
_VIS = f"NOT {q.is_hidden('path')}"
_EXT = f"CASE WHEN {q.suffix('path')} = '' THEN '(no extension)' ELSE {q.suffix('path')} END"
_SPLITLINES = (
    f"(length(regexp_replace(content, {q.s(LB)}, chr(10), 'g')) - length(replace(regexp_replace(content, {q.s(LB)}, chr(10), 'g'), chr(10), ''))"
    f" + CASE WHEN length(content) > 0 AND NOT suffix(regexp_replace(content, {q.s(LB)}, chr(10), 'g'), chr(10)) THEN 1 ELSE 0 END)"
)


@register("extension_counts", "A1", f"""
SELECT project, ext, n, rank FROM (
  SELECT project, ext, n, CAST(row_number() OVER (PARTITION BY project ORDER BY n DESC, ext) AS BIGINT) AS rank
  FROM (SELECT project, ext, count(*) AS n FROM (SELECT project, {_EXT} AS ext FROM files WHERE {_VIS}) GROUP BY ALL)) WHERE rank <= 20
""")
def q_extension_counts(spark, sf):
    return st.extension_counts(t.files(spark, sf), 20)


@register("project_summary", "A1", f"""
SELECT project, count(*) AS total_files,
       CAST(sum(CASE WHEN {q.suffix('path')} IN ('.py', '.js', '.ts', '.md', '.txt') THEN {_SPLITLINES} ELSE 0 END) AS BIGINT) AS estimated_lines
FROM files WHERE {_VIS} GROUP BY project
""")
def q_project_summary(spark, sf):
    return st.project_summary(t.files(spark, sf))


@register("snapshot_stats", "A3/X9", """
SELECT project, count(*) AS files, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(length(content)) // 4 AS BIGINT) AS tokens,
  CASE WHEN sum(length(content)) // 4 <= 32000 THEN 'TIER_1_FULL' WHEN sum(length(content)) // 4 <= 128000 THEN 'TIER_2_FULL' ELSE 'TIER_3_RAG' END AS tier,
  CASE WHEN sum(length(content)) // 4 < 32000 THEN 'Small project - fits in all LLMs'
       WHEN sum(length(content)) // 4 < 128000 THEN 'Medium project - fits in GPT-4/Claude/Gemini'
       ELSE 'Large project - may need RAG fallback' END AS summary_tier,
  CASE WHEN sum(length(content)) // 4 > 128000 THEN 'WARNING: Exceeds typical 128k context window.'
       WHEN sum(length(content)) // 4 > 32000 THEN 'INFO: Fits comfortably in GPT-4 / Claude 3.'
       ELSE 'OK: Fits in nearly all modern LLMs.' END AS render_note,
  sum(length(content)) // 4 <= 128000 * 0.7 AS fits_full
FROM files GROUP BY project
""")
def q_snapshot_stats(spark, sf):
    return st.snapshot_stats(t.files(spark, sf))


@register("list_dir", "A7", """
WITH k AS (SELECT DISTINCT project,
             CASE WHEN len(string_split(substr(path, 4), '/')) > 1 THEN string_split(substr(path, 4), '/')[1] || '/' ELSE string_split(substr(path, 4), '/')[1] END AS name,
             CASE WHEN len(string_split(substr(path, 4), '/')) > 1 THEN 'dir' ELSE 'file' END AS kind
           FROM files WHERE starts_with(path, 'en/') AND NOT starts_with(string_split(substr(path, 4), '/')[1], '.'))
SELECT project, kind, name, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project, kind ORDER BY name) AS BIGINT) AS rank FROM k)
WHERE (kind = 'dir' AND rank <= 50) OR (kind = 'file' AND rank <= 100)
""")
def q_list_dir(spark, sf):
    return st.list_dir(t.files(spark, sf), "en", max_dirs=50, max_files=100)


@register("doc_audit", "A9")
def q_doc_audit(spark, sf):
    return st.doc_audit_summary(st.doc_audit(t.files(spark, sf)))


@register("tree_lines", "A6", f"""WITH {TREE_LINES.strip()}
SELECT project, array_to_string(p, '/') AS node, prefix || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || p[-1] AS line FROM tw
UNION ALL SELECT DISTINCT project, '', '.' FROM files
""")
def q_tree_lines(spark, sf):
    return tr.tree_lines(t.files(spark, sf)).select("project", F.array_join("parts", "/").alias("node"), "line")


@register("tree_length", "A6", """
SELECT project, CAST(1 + sum(1 + 4 * len(p) + length(p[-1])) AS BIGINT) AS tree_chars FROM (
  SELECT DISTINCT project, parts[1:i] AS p FROM (
    SELECT project, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT project, string_split(path, '/') AS parts FROM files)))
GROUP BY project
""")
def q_tree_length(spark, sf):
    return tr.tree_length(t.files(spark, sf))


_SUFFIX_SUM = "sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FROM_END = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"


@register("trim_history", "W3", f"""
SELECT conv_id, turn, role, CAST(length(text) // 4 AS BIGINT) AS tokens,
       ({_SUFFIX_SUM} <= {TRIM_TOKENS}) OR ({_FROM_END} <= 4) AS keep
FROM conversations
""")
def q_trim_history(spark, sf):
    c = t.table(spark, sf, "conversations")
    return mem.trim_history(c, max_tokens=TRIM_TOKENS).select("conv_id", "turn", "role", "tokens", "keep")


@register("trim_summary", "W4/X11", f"""
WITH k AS (SELECT *, ({_SUFFIX_SUM} <= {TRIM_TOKENS}) OR ({_FROM_END} <= 4) AS keep FROM conversations)
SELECT conv_id, count(*) AS removed,
       'Earlier conversation:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' ||
         CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END, chr(10) ORDER BY turn) AS summary
FROM k WHERE NOT keep GROUP BY conv_id
""")
def q_trim_summary(spark, sf):
    return mem.trim_summary(t.table(spark, sf, "conversations"), max_tokens=TRIM_TOKENS)


@register("memory_stats", "A4", """
SELECT conv_id, count(*) AS message_count, CAST(0 AS BIGINT) AS context_tokens, CAST(sum(length(text) // 4) AS BIGINT) AS message_tokens,
       CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens, CAST(128000 AS BIGINT) AS max_tokens,
       CAST(greatest(128000 - sum(length(text) // 4), 0) AS BIGINT) AS available_tokens,
       sum(length(text) // 4) / 128000 * 100 AS usage_percent
FROM conversations GROUP BY conv_id
""")
def q_memory_stats(spark, sf):
    return mem.memory_stats(t.table(spark, sf, "conversations"))


@register("transcript", "X13", """
SELECT conv_id, 'You are helpful.' || chr(10) || chr(10) ||
       string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text || chr(10) || chr(10), '' ORDER BY turn) || 'Assistant:' AS prompt
FROM conversations GROUP BY conv_id
""")
def q_transcript(spark, sf):
    return mem.transcript(t.table(spark, sf, "conversations"), system_prompt="You are helpful.")


@register("message_preview", "X11", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS label,
       CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
FROM conversations
""")
def q_message_preview(spark, sf):
    c = t.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.role_label("role").alias("label"), X.message_preview("text").alias("preview"))


_RAW = "'./' || project || '/../' || replace(path, '/', '\\')"


@register("path_parts", "X1", f"""
SELECT project, path, {q.normalize(_RAW)} AS norm, {q.basename(_RAW)} AS base, {q.suffix(_RAW)} AS ext,
       {q.parent(_RAW)} AS parent, {q.depth(_RAW)} AS depth
FROM files
""")
def q_path_parts(spark, sf):
    f = t.files(spark, sf)
    raw = F.concat(F.lit("./"), "project", F.lit("/../"), F.replace(F.col("path"), F.lit("/"), F.lit("\\")))
    return f.select("project", "path", P.normalize_path(raw).alias("norm"), P.basename(raw).alias("base"),
                    P.suffix(raw).alias("ext"), P.parent(raw).alias("parent"), P.depth(raw).alias("depth"))


@register("text_metrics", "X2/X3/X4", """
SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines, CAST(length(text) AS BIGINT) AS chars,
       md5(text) AS md5, sha256(text) AS sha256
FROM documents
""")
def q_text_metrics(spark, sf):
    d = t.table(spark, sf, "documents")
    return d.select("doc_id", X.tokens("text").alias("tokens"), X.line_count("text").alias("lines"),
                    X.char_count("text").alias("chars"), X.md5_hex("text").alias("md5"), X.sha256_hex("text").alias("sha256"))


@register("embed_input", "X5", """
SELECT project, path, 'File: ' || path || chr(10) || chr(10) || content AS embed_text FROM files
""")
def q_embed_input(spark, sf):
    f = t.files(spark, sf)
    return f.select("project", "path", X.embed_input("path", "content").alias("embed_text"))


@register("render_safe_text", "X6/X7", r"""
SELECT doc_id,
       replace(regexp_replace(text, '[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]', '?', 'g'), chr(0), '') AS glyph_safe,
       regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') AS latin1, replace(text, chr(0), '') AS utf8
FROM documents
""")
def q_render_safe_text(spark, sf):
    d = t.table(spark, sf, "documents")
    return d.select("doc_id", X.glyph_filter("text").alias("glyph_safe"), X.latin1_fallback("text").alias("latin1"), X.sanitize_utf8("text").alias("utf8"))


@register("fence_lang", "X8", f"""
SELECT project, path, CASE WHEN lower({q.suffix('path')}) = '' THEN 'text' ELSE substr(lower({q.suffix('path')}), 2) END AS lang FROM files
""")
def q_fence_lang(spark, sf):
    f = t.files(spark, sf)
    return f.select("project", "path", X.fence_lang("path").alias("lang"))


@register("file_label", "X12", """
SELECT doc_id, '--- FILE: ' || {p} || ' (' || CAST(doc_id AS VARCHAR) || ') ---' || chr(10) || chr(10) || text AS labeled FROM documents
""".replace("{p}", "'doc_' || CAST(doc_id AS VARCHAR) || '.txt'"))
def q_file_label(spark, sf):
    d = t.table(spark, sf, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", X.file_label(name, "doc_id", "text").alias("labeled"))


@register("named_read_file", "U2", """
WITH r AS (SELECT doc_id AS id, source AS project, CASE WHEN doc_id % 3 = 0 THEN 'missing/' || dpath ELSE dpath END AS path FROM doc_paths),
l AS (SELECT project, path, CASE WHEN ord % 50 = 0 THEN repeat(content, 1 + 1048576 // greatest(octet_length(encode(content)), 1)) ELSE content END AS content FROM files)
SELECT r.id, r.project, r.path, CASE WHEN l.path IS NULL THEN 'not_found' WHEN octet_length(encode(l.content)) > 1048576 THEN 'too_large' ELSE 'ok' END AS status,
       CASE WHEN octet_length(encode(l.content)) <= 1048576 THEN md5(l.content) END AS md5
FROM r LEFT JOIN l USING (project, path)
""")
def q_named_read_file(spark, sf):
    f = t.files(spark, sf)
    long = F.repeat("content", F.expr("CAST(1 + 1048576 DIV greatest(octet_length(content), 1) AS INT)"))
    f = f.withColumn("content", F.when(F.col("ord") % 50 == 0, long).otherwise(F.col("content")))
    req = t.files(spark, sf).select(F.col("ord").alias("id"), "project", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("missing/"), "path")).otherwise(F.col("path")).alias("path"))
    return nm.read_file(f, req).select("id", "project", "path", "status", F.md5("text").alias("md5"))


@register("named_summary", "U2", """
WITH e AS (SELECT project, path, content, CASE WHEN regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1) = '' THEN '(no extension)'
             ELSE regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1) END AS ext FROM files WHERE NOT starts_with(path, '.git/'))
SELECT project, count(*) AS total_files, count(DISTINCT ext) AS kinds FROM e GROUP BY project
""")
def q_named_summary(spark, sf):
    s = nm.NAMED["get_project_summary"](t.files(spark, sf))
    return s.select("project", "total_files", F.size("files_by_extension").cast("long").alias("kinds"))
