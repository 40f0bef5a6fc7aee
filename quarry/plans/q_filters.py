"""Catalog entries: predicates and filters."""

from pyspark.sql import functions as F

from quarry.functions import wildcard as W
from quarry.operators import filters as fl
from quarry.operators import responses as rs
from quarry.plans import sqlfrag as q
from quarry.plans.registry import register
from quarry.sources import tables as t

IGNORE_PATTERNS = ["node_modules/", "build/", "*.pyc", "*.json", "!de/**/*.json", "!build/de", "# comment", ""]
_IGN = W.compile_rules(IGNORE_PATTERNS)
EXCLUDE_PATTERNS = ["*.md", "fr/part[0-4]/*", "!fr/part2/*.md"]
_EXC = W.compile_rules(EXCLUDE_PATTERNS, ())
SCOPE = "en"
SCOPE_CUSTOM = ["part3/", "*.txt"]
_SCOPE_RULES = W.compile_rules([p for g in ("venv", "pycache", "git", "node") for p in W.DEFAULT_GROUPS[g]] + SCOPE_CUSTOM)


@register("extension_filter", "P1",
          f"SELECT project, path FROM files WHERE {q.ends_any('path', fl.DEFAULT_EXTENSIONS)}")
def q_extension_filter(spark, sf):
    return fl.extension_filter(t.files(spark, sf)).select("project", "path")


_PRESET_VALUES = ", ".join(f"({q.s(n)}, {q.s(e)})" for n, es in fl.EXTENSION_PRESETS.items() for e in es)


@register("preset_matches", "P2", f"""
SELECT p.preset, f.project, f.path
FROM files f JOIN (VALUES {_PRESET_VALUES}) p(preset, ext) ON {q.suffix('f.path')} = p.ext
""")
def q_preset_matches(spark, sf):
    return fl.preset_matches(t.files(spark, sf), fl.presets_table(spark))


@register("ignore_filter", "P3",
          f"SELECT project, path FROM files WHERE NOT {W.sql_ignored('path', _IGN)}")
def q_ignore_filter(spark, sf):
    return fl.ignore_filter(t.files(spark, sf), IGNORE_PATTERNS).select("project", "path")


#: Rule lists by the parity of the project's number.
PROJECT_RULES = {0: ["*.pyc", "en/", "!en/part3/", "/de/part1/*.md", "build/"], 1: ["part5/", "*.json", "!doc_*1.json", "node_modules/", "de/**"]}


def _project_rules(spark, sf):
    """(project, position, line): a rule list for every project of the files."""
    parity = F.expr("CAST(substring(project, 4) AS INT) % 2")
    lists = F.when(parity == 0, F.array(*map(F.lit, PROJECT_RULES[0]))).otherwise(F.array(*map(F.lit, PROJECT_RULES[1])))
    return t.files(spark, sf).select("project").distinct().select("project", F.posexplode(lists).alias("position", "line"))


def _rules_sql(always):
    rules = [(k, r) for k, lines in PROJECT_RULES.items() for r in W.compile_rules(lines, always)]
    values = ", ".join(f"({k}, {r.idx}, {q.s(r.regex)}, {'true' if r.ignore else 'false'})" for k, r in rules)
    return f"rules(k, pos, rx, ign) AS (VALUES {values})"


@register("ignore_rules_by_project", "P3", f"""
WITH {_rules_sql(W.ALWAYS_IGNORED)},
n AS (SELECT project, path AS node FROM files UNION
      SELECT project, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/') || '/')) AS node FROM files),
m AS (SELECT n.project, n.node, arg_max(r.ign, r.pos) AS ign FROM n JOIN rules r ON CAST(substr(n.project, 4) AS INT) % 2 = r.k AND regexp_matches(n.node, r.rx) GROUP BY 1, 2)
SELECT f.project, f.path FROM files f WHERE NOT EXISTS (
  SELECT 1 FROM m WHERE m.ign AND m.project = f.project AND (m.node = f.path OR (suffix(m.node, '/') AND starts_with(f.path, m.node))))
""")
def q_ignore_rules_by_project(spark, sf):
    return fl.project_ignore_filter(t.files(spark, sf), _project_rules(spark, sf)).select("project", "path")


@register("exclude_rules_by_project", "P4", f"""
WITH {_rules_sql(())},
m AS (SELECT n.project, n.path, arg_max(r.ign, r.pos) AS ign FROM files n JOIN rules r ON CAST(substr(n.project, 4) AS INT) % 2 = r.k AND regexp_matches(n.path, r.rx) GROUP BY 1, 2)
SELECT f.project, f.path FROM files f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.ign AND m.project = f.project AND m.path = f.path)
""")
def q_exclude_rules_by_project(spark, sf):
    return fl.project_ignore_filter(t.files(spark, sf), _project_rules(spark, sf), always=(), prune=False).select("project", "path")


@register("exclude_filter", "P4",
          f"SELECT project, path FROM files WHERE NOT {W.sql_matches('path', _EXC)}")
def q_exclude_filter(spark, sf):
    return fl.exclude_filter(t.files(spark, sf), EXCLUDE_PATTERNS).select("project", "path")


@register("scan_scope", "P5", f"""
SELECT project, path FROM files
WHERE starts_with(path, '{SCOPE}/')
  AND NOT {W.sql_ignored(f"substr(path, {len(SCOPE) + 2})", _SCOPE_RULES)}
  AND {q.ends_any('path', fl.DEFAULT_EXTENSIONS)} AND NOT contains(path, '{fl.PROJECT_CONFIG_FILE}')
""")
def q_scan_scope(spark, sf):
    return fl.scan_scope(t.files(spark, sf), SCOPE, custom=SCOPE_CUSTOM)


@register("name_search", "P6", f"""
SELECT project, path FROM files
WHERE contains(lower({q.basename('path')}), 'doc_1') AND {q.ends_any('path', fl.SEARCH_EXTENSIONS)}
""")
def q_name_search(spark, sf):
    return fl.name_search(t.files(spark, sf), "DOC_1")


@register("path_search", "P7", """
SELECT project, path, content, CAST(0.5 AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY ord) AS rn FROM files
  WHERE contains(lower(path), 'part3/doc_') AND length(content) > 0) WHERE rn <= 5
""")
def q_path_search(spark, sf):
    return fl.path_search(t.files(spark, sf), "PART3/doc_", 5)


@register("size_guards", "P8", """
SELECT doc_id, octet_length(encode(text)) <= 1048576 AS readable,
       length(text) >= 1 AND length(text) <= 50000 AS indexable, length(text) >= 100 AS ingestable
FROM documents
""")
def q_size_guards(spark, sf):
    d = t.table(spark, sf, "documents")
    return fl.size_guards(d, "text").select("doc_id", "readable", "indexable", "ingestable")


@register("hidden_filter", "P9", f"SELECT project, path FROM files WHERE NOT {q.is_hidden('path')}")
def q_hidden_filter(spark, sf):
    return fl.hidden_filter(t.files(spark, sf)).select("project", "path")


@register("unsafe_paths", "P10", f"""
WITH b AS (SELECT id, regexp_replace(regexp_replace(trim(text), '^```[^\\n]*\\n', ''), '\\n[ \\t]*```$', '') AS body FROM selections),
p AS (SELECT id, unnest(from_json(body, '["VARCHAR"]')) AS path FROM b WHERE json_valid(body) AND json_type(body) = 'ARRAY')
SELECT id, path, NOT (starts_with({q.normalize('path')}, '..') OR starts_with({q.normalize('path')}, '/') OR regexp_matches({q.normalize('path')}, '^[A-Za-z]:')) AS restore_safe,
       NOT (contains(path, '..') OR starts_with(path, '/') OR starts_with(path, '\\')) AS patch_safe,
       CASE WHEN starts_with({q.normalize('path')}, '..') THEN 'escapes_root' WHEN starts_with({q.normalize('path')}, '/') THEN 'absolute'
            WHEN contains(path, '..') THEN 'dotdot' WHEN starts_with(path, '\\') THEN 'absolute' END AS reason
FROM p WHERE path IS NOT NULL
""")
def q_unsafe_paths(spark, sf):
    sel = rs.parse_selection(t.selections(spark, sf))
    p = sel.select("id", F.explode("paths").alias("path")).where(F.col("path").isNotNull())
    return fl.unsafe_paths(p)


@register("project_search_scope", "P11", f"""
SELECT project, path FROM files
WHERE len(string_split(path, '/')) - 1 < 3
  AND NOT list_has_any(string_split(path, '/')[1:len(string_split(path, '/')) - 1],
                       {['.git', '.venv', 'venv', 'node_modules', '__pycache__', '.idea', '.vscode', 'dist', 'build']})
""")
def q_project_search_scope(spark, sf):
    return fl.project_search_scope(t.files(spark, sf), 3).select("project", "path")


@register("role_check", "P12",
          "SELECT conv_id, turn, role, role IN ('user', 'assistant') AS valid FROM conversations")
def q_role_check(spark, sf):
    return fl.role_check(t.table(spark, sf, "conversations")).select("conv_id", "turn", "role", "valid")
