"""Catalog entries: gathering (S1-S4). The on-disk tree for S1/S2 is written from the
``files`` table below the checkpoint folder, so its size follows the input."""

from pyspark.sql import functions as F

from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import gather as ga
from quarry.sources import tables as t


# Beside the table's files each project gets names that listings like to hide, a file that
# is no UTF-8 and one in an ignored folder.
_EXTRA = {"__init__.py": "print(1)", ".env": "A=1", ".github/ci.yml": "on: push", "_docs/x.md": "# x", "node_modules/deep/y.js": "y"}
_BAD = "bad.bin"


@register("scan_read_tree", "S1/S2", f"""
SELECT project, path, md5(content) AS md5 FROM files WHERE NOT starts_with(path, '.git/') AND NOT starts_with(path, 'node_modules/')
UNION ALL
SELECT p.project, e.path, md5(e.content) FROM (SELECT DISTINCT project FROM files) p,
  (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _EXTRA.items() if not k.startswith("node_modules/"))}, ('{_BAD}', 'Error: Could not read file')) e(path, content)
""")
def q_scan_read_tree(spark, sf):
    root = scratch_path(spark, "tree")
    f = t.files(spark, sf)
    extra = [F.struct(F.lit(k).alias("path"), F.lit(v).cast("binary").alias("data")) for k, v in _EXTRA.items()]
    extra.append(F.struct(F.lit(_BAD).alias("path"), F.unhex(F.lit("FFFE80")).alias("data")))
    more = f.select("project").distinct().select("project", F.explode(F.array(*extra)).alias("e")).select("project", "e.path", "e.data")
    ga.write_tree(f.select("project", "path", F.col("content").cast("binary").alias("data")).unionByName(more), root)
    rd = ga.read_tree(spark, root, ignore_patterns=["node_modules/"])
    return rd.select(F.substring_index("rel", "/", 1).alias("project"), F.expr("substring(rel, instr(rel, '/') + 1)").alias("path"),
                     F.md5("text").alias("md5"))


@register("gather", "S3", """
WITH sel AS (SELECT id, project, unnest(from_json(body, '["VARCHAR"]')) AS path FROM (
       SELECT id, project, regexp_replace(regexp_replace(trim(text), '^```[^\\n]*\\n', ''), '\\n[ \\t]*```$', '') AS body FROM selections)
       WHERE json_valid(body) AND json_type(body) = 'ARRAY'),
u AS (SELECT project, path, 0 AS prio, id AS ord FROM sel WHERE NOT starts_with(path, '/')
      UNION ALL SELECT project, path, 1 AS prio, ord FROM files WHERE suffix(path, '.md') OR suffix(path, '.py')),
f AS (SELECT project, path, min(prio * 1000000000 + ord) AS k FROM u GROUP BY ALL)
SELECT project, path, CAST(k // 1000000000 AS INTEGER) AS prio, k % 1000000000 AS ord FROM f
WHERE EXISTS (SELECT 1 FROM files_b b WHERE b.project = f.project AND b.path = f.path)
  AND NOT regexp_matches(path, '^(?:.*/)?[^/]*\\.json(?:/.*)?$')
""")
def q_gather(spark, sf):
    from quarry.operators import responses as rs

    sel = rs.parse_selection(t.selections(spark, sf)).select("id", "project", F.explode("paths").alias("path"))
    explicit = sel.where(~F.col("path").startswith("/")).select("project", "path", F.col("id").alias("ord"))
    return ga.gather(explicit, t.files(spark, sf), t.files_b(spark, sf), exclude=["*.json"], autodiscover_ext=[".md"],
                     autodiscover_py=True)


@register("inject_rows", "S4", """
SELECT project, path, ord, length(content) AS n FROM files
UNION ALL SELECT project, '000_CONTEXT.md', min(ord) - 1, 7 FROM files GROUP BY project
UNION ALL SELECT project, 'zzz_ENVIRONMENT.md', max(ord) + 1, 11 FROM files GROUP BY project
""")
def q_inject_rows(spark, sf):
    out = ga.inject_rows(t.files(spark, sf), "context", "environment")
    return out.select("project", "path", "ord", F.length("content").cast("long").alias("n"))
