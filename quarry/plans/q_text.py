"""Catalog entries: secrets (R1-R3, A8, X10) and responses / tool results /
selections (R4-R11, J13, J14, W8)."""

from pyspark.sql import functions as F

from quarry.operators import responses as rs
from quarry.operators import secrets as se
from quarry.plans import sqlfrag as q
from quarry.plans.registry import register
from quarry.sources import tables as t

WHITELIST = ["0000000000000000000000000000000000000000"]

_LINES = """
lines AS (SELECT * FROM (SELECT project, path, generate_subscripts(ls, 1) AS line, unnest(ls) AS ctx
          FROM (SELECT project, path, string_split(content, chr(10)) AS ls FROM files WHERE regexp_matches(content, {any})))
          WHERE regexp_matches(ctx, {any})),
cands AS ({union})
""".replace("{any}", q.s(se.ANY_RULE)).replace("{union}", " UNION ALL ".join(
    f"SELECT project, path, CAST(line AS BIGINT) AS line, {q.s(ty)} AS type, {q.s(cf)} AS confidence, trim(ctx) AS context, "
    f"unnest(regexp_extract_all(ctx, {q.s(rx)}, {g})) AS value FROM lines"
    for ty, rx, g, cf in se.RULES))


@register("secret_scan", "R1", f"WITH {_LINES} SELECT * FROM cands WHERE length(value) > 0")
def q_secret_scan(spark, sf):
    return se.scan(t.files(spark, sf))


@register("secret_summary", "A8", f"""
WITH {_LINES} SELECT type, confidence, count(*) AS n, count(DISTINCT value) AS distinct_values FROM cands WHERE length(value) > 0 GROUP BY ALL
""")
def q_secret_summary(spark, sf):
    return se.candidate_summary(se.scan(t.files(spark, sf)))


@register("secret_preview", "X10", f"""
WITH {_LINES} SELECT project, path, line, type, CASE WHEN length(value) > 16 THEN substr(value, 1, 8) || '...' || substr(value, -4) ELSE value END AS preview
FROM cands WHERE length(value) > 0
""")
def q_secret_preview(spark, sf):
    return se.with_preview(se.scan(t.files(spark, sf))).select("project", "path", "line", "type", "preview")


def _redact_sql(whitelist, files="files"):
    wl = "[" + ", ".join(q.s(w) for w in whitelist) + "]::VARCHAR[]"
    return f"""SELECT project, path, list_reduce(list_prepend(content, coalesce((
  SELECT list(value ORDER BY length(value) DESC, value) FROM (
    WITH {_LINES.replace('FROM files ', f'FROM {files} ')} SELECT DISTINCT value FROM cands WHERE length(value) > 0 AND NOT list_contains({wl}, value))), []::VARCHAR[])),
  lambda acc, v: replace(acc, v, '[REDACTED SECRET]')) AS content FROM {files}"""


@register("redact", "R2", _redact_sql(WHITELIST))
def q_redact(spark, sf):
    return se.redact(t.files(spark, sf), WHITELIST).select("project", "path", "content")


@register("scrub", "R3", _redact_sql([]))
def q_scrub(spark, sf):
    return se.scrub(t.files(spark, sf)).select("project", "path", "content")


@register("citations", "R4", r"""
SELECT conv_id, turn, unnest(list_sort(list_distinct(regexp_extract_all(text, '\[\[REF:\s*(.*?)\]\]', 1)))) AS source FROM responses
""")
def q_citations(spark, sf):
    return rs.citations(t.responses(spark, sf))


@register("citation_links", "R5", r"""
SELECT conv_id, turn, regexp_replace(text, '\[\[REF:\s*(.*?)\]\]', '[`\1`](ref://\1)', 'g') AS text FROM responses
""")
def q_citation_links(spark, sf):
    return rs.citation_links(t.responses(spark, sf))


_STRIP = "regexp_extract({x}, '(?s)^\\s*(.*?)\\s*$', 1)"
_SEGMENTS = f"""
a AS (SELECT * FROM (SELECT conv_id, turn, generate_subscripts(parts, 1) - 1 AS p1, unnest(parts) AS part FROM (
        SELECT conv_id, turn, string_split(regexp_replace(replace(text, chr(1), ''), '(?s)(<think>.*?</think>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts
        FROM responses)) WHERE length({_STRIP.format(x='part')}) > 0),
th AS (SELECT conv_id, turn, p1, 0 AS p2, 'thought' AS kind, {_STRIP.format(x="regexp_extract(part, '(?s)^<think>(.*?)</think>$', 1)")} AS body,
              CAST(NULL AS VARCHAR) AS file FROM a WHERE regexp_matches(part, '(?s)^<think>(.*?)</think>$')),
b AS (SELECT * FROM (SELECT conv_id, turn, p1, generate_subscripts(subs, 1) - 1 AS p2, unnest(subs) AS sub FROM (
        SELECT conv_id, turn, p1, string_split(regexp_replace(part, '(?s)(<patch file=".*?">.*?</patch>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS subs
        FROM a WHERE NOT regexp_matches(part, '(?s)^<think>(.*?)</think>$'))) WHERE length({_STRIP.format(x='sub')}) > 0),
seg AS (
  SELECT * FROM th WHERE length(body) > 0
  UNION ALL
  SELECT conv_id, turn, p1, p2,
         CASE WHEN regexp_matches(sub, '(?s)^<patch file="(.*?)">(.*?)</patch>$') THEN 'patch' ELSE 'text' END AS kind,
         CASE WHEN regexp_matches(sub, '(?s)^<patch file="(.*?)">(.*?)</patch>$') THEN regexp_extract(sub, '(?s)^<patch file="(.*?)">(.*?)</patch>$', 2)
              ELSE {_STRIP.format(x='sub')} END AS body,
         CASE WHEN regexp_matches(sub, '(?s)^<patch file="(.*?)">(.*?)</patch>$') THEN regexp_extract(sub, '(?s)^<patch file="(.*?)">(.*?)</patch>$', 1) END AS file
  FROM b)
"""


@register("segments", "R6", f"WITH {_SEGMENTS} SELECT conv_id, turn, CAST(p1 AS BIGINT) AS p1, CAST(p2 AS BIGINT) AS p2, kind, body, file FROM seg")
def q_segments(spark, sf):
    return rs.segments(t.responses(spark, sf))


_PATCHES = "SELECT conv_id, turn, p1, p2, file, body AS code, NOT (contains(file, '..') OR starts_with(file, '/') OR starts_with(file, '\\')) AS safe FROM seg WHERE kind = 'patch'"


@register("patches", "R7", f"WITH {_SEGMENTS} SELECT conv_id, turn, CAST(p1 AS BIGINT) AS p1, CAST(p2 AS BIGINT) AS p2, file, code, safe FROM ({_PATCHES})")
def q_patches(spark, sf):
    return rs.patches(t.responses(spark, sf))


@register("apply_patches", "R8", f"""
WITH {_SEGMENTS}, p AS ({_PATCHES}),
last AS (SELECT r.project, file AS path, arg_max(code, conv_id * 1000000000 + turn * 1000000 + p1 * 1000 + p2) AS new_content
         FROM p JOIN responses r USING (conv_id, turn) WHERE safe GROUP BY ALL),
j AS (SELECT f.*, l.new_content FROM files f LEFT JOIN last l USING (project, path))
SELECT project, path, ord, CAST(length(coalesce(new_content, content)) AS BIGINT) AS n_chars, new_content IS NOT NULL AS patched FROM j
UNION ALL
SELECT project, path || '.bak', ord, CAST(length(content) AS BIGINT), false FROM j WHERE new_content IS NOT NULL
""")
def q_apply_patches(spark, sf):
    out = rs.apply_patches(t.files(spark, sf), rs.patches(t.responses(spark, sf), ("conv_id", "turn", "project")))
    return out.select("project", "path", "ord", F.length("content").cast("long").alias("n_chars"), "patched")


_PARSE = """
SELECT id, project, CASE WHEN coalesce(try(json_type(body)) = 'ARRAY', false) THEN 'ok' ELSE 'invalid' END AS status,
       CAST(len(try(from_json(body, '["VARCHAR"]'))) AS INTEGER) AS n_paths
FROM (SELECT id, project, regexp_extract(regexp_replace(regexp_replace(regexp_extract(text, '(?s)^\\s*(.*?)\\s*$', 1), '^```[^\\n]*\\n', ''),
      '\\n[ \\t]*```$', ''), '(?s)^\\s*(.*?)\\s*$', 1) AS body FROM selections)
"""


@register("parse_selection", "R9", _PARSE)
def q_parse_selection(spark, sf):
    s = rs.parse_selection(t.selections(spark, sf))
    return s.select("id", "project", "status", F.size("paths").alias("n_paths")).withColumn(
        "n_paths", F.when(F.col("status") == "ok", F.col("n_paths")))


_FLAT = """
SELECT name, CASE WHEN json_valid(content) AND json_type(content) = 'ARRAY'
  THEN array_to_string(list_filter(list_transform(CAST(content AS JSON[]), lambda b: CASE WHEN json_type(b) = 'OBJECT' THEN b->>'text' ELSE b->>'$' END), lambda x: x IS NOT NULL), chr(10))
  ELSE content END AS text FROM tool_results
"""


@register("flatten_text", "R10", _FLAT)
def q_flatten_text(spark, sf):
    r = t.tool_results(spark, sf)
    return r.select("name", rs.flatten_text("content").alias("text"))


@register("tool_rows", "R11/T2", f"""
SELECT string_split(name, '__')[1] AS server, array_to_string(string_split(name, '__')[2:], '__') AS tool, 'mcp://' || name AS source_id,
       text, CAST(length(text) AS BIGINT) AS n_chars, length(text) >= 100 AS ingestable
FROM ({_FLAT}) WHERE contains(name, '__')
""")
def q_tool_rows(spark, sf):
    return rs.tool_rows(t.tool_results(spark, sf))


_CANON = q.normalize("req.path")


@register("reconcile_selection", "J13", f"""
WITH {{_PARSE_REQ}}
SELECT id, project, CASE WHEN starts_with({_CANON}, '/project/root/' || project || '/') THEN substr({_CANON}, length('/project/root/' || project || '/') + 1)
                         ELSE {_CANON} END AS path
FROM req WHERE path IS NOT NULL AND EXISTS (SELECT 1 FROM files f WHERE f.project = req.project AND f.path =
  CASE WHEN starts_with({_CANON}, '/project/root/' || req.project || '/') THEN substr({_CANON}, length('/project/root/' || req.project || '/') + 1) ELSE {_CANON} END)
""".replace("{_PARSE_REQ}", __import__("quarry.plans.q_store", fromlist=["_REQ"])._REQ.strip()))
def q_reconcile_selection(spark, sf):
    from quarry.plans.q_store import _requests

    return rs.reconcile_selection(t.files(spark, sf), _requests(spark, sf), "/project/root/")


@register("excluded_files", "J14", f"""
WITH {{_PARSE_REQ}},
sel AS (SELECT req.project, CASE WHEN starts_with({_CANON}, '/project/root/' || req.project || '/')
               THEN substr({_CANON}, length('/project/root/' || req.project || '/') + 1) ELSE {_CANON} END AS path FROM req WHERE path IS NOT NULL)
SELECT project, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.project = f.project AND sel.path = f.path)
""".replace("{_PARSE_REQ}", __import__("quarry.plans.q_store", fromlist=["_REQ"])._REQ.strip()))
def q_excluded_files(spark, sf):
    from quarry.plans.q_store import _requests

    sel = rs.reconcile_selection(t.files(spark, sf), _requests(spark, sf), "/project/root/")
    return rs.excluded_files(t.files(spark, sf), sel)


@register("capped_list", "W8", """
SELECT project, path, rank, n_files, n_files > 20 AS truncated FROM (
  SELECT project, path, CAST(row_number() OVER (PARTITION BY project ORDER BY ord) AS BIGINT) AS rank, count(*) OVER (PARTITION BY project) AS n_files FROM files)
WHERE rank <= 20
""")
def q_capped_list(spark, sf):
    return rs.capped_list(t.files(spark, sf), 20)


@register("briefing_list", "W8", """
WITH r AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY ord) AS a, row_number() OVER (PARTITION BY project ORDER BY ord DESC) AS z,
           count(*) OVER (PARTITION BY project) AS n_files FROM files)
SELECT project, path, 'first' AS "end", a AS rank, n_files, n_files > 20 AS truncated FROM r WHERE a <= 10
UNION ALL SELECT project, path, 'last', z, n_files, n_files > 20 FROM r WHERE z <= 10 AND a > 10
""")
def q_briefing_list(spark, sf):
    return rs.briefing_list(t.files(spark, sf), 10)
