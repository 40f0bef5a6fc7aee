"""Catalog entries: content store (S15-S17, J1-J3, A2) and registry (W6, W7, W9,
J15, J17, J18)."""

from pyspark.sql import functions as F

from quarry.operators import changes as ch
from quarry.operators import context as cx
from quarry.operators import registry as rg
from quarry.operators import responses as rs
from quarry.operators import stats as st
from quarry.operators import vectors as vx
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import store as sto
from quarry.sources import tables as t

NOW = "2024-01-01 00:00:00"
MARKER = ".json"
_LC = "CAST(length({c}) - length(replace({c}, chr(10), '')) + 1 AS INTEGER)"


def _store_a(spark, sf):
    return sto.as_store_rows(t.files_a(spark, sf), NOW)


@register("store_upsert", "S15", f"""
WITH s AS (SELECT project, path, md5(content) AS h, content FROM files_a),
     u AS (SELECT project, path, md5(content) AS h, content FROM files_b)
SELECT project, path, coalesce(u.h, s.h) AS file_hash, CAST(length(coalesce(u.content, s.content)) AS INTEGER) AS file_size,
       {_LC.format(c='coalesce(u.content, s.content)')} AS line_count
FROM s FULL OUTER JOIN u USING (project, path)
""")
def q_store_upsert(spark, sf):
    return sto.upsert(_store_a(spark, sf), t.files_b(spark, sf), NOW).select("project", "path", "file_hash", "file_size", "line_count")


_ACTIONS = """
SELECT project, path, CASE WHEN s.h IS NULL THEN 'insert'
  WHEN u.h IS NULL THEN CASE WHEN project IN (SELECT project FROM files_in) THEN 'delete' ELSE 'keep' END
  WHEN s.h <> u.h THEN 'update' ELSE 'keep' END AS action
FROM (SELECT project, path, md5(content) AS h FROM files_a) s FULL OUTER JOIN (SELECT project, path, md5(content) AS h FROM files_in) u USING (project, path)
"""


@register("sync_store", "J3", _ACTIONS)
def q_sync_store(spark, sf):
    return sto.sync_actions(_store_a(spark, sf), t.files_incoming(spark, sf)).select("project", "path", "action")


@register("sync_counts", "J3", f"""
WITH a AS ({_ACTIONS})
SELECT project, count(*) FILTER (WHERE action IN ('insert', 'update')) AS updated, count(*) FILTER (WHERE action = 'delete') AS deleted,
       count(*) FILTER (WHERE action = 'keep') AS kept FROM a GROUP BY project
""")
def q_sync_counts(spark, sf):
    return sto.action_counts(sto.sync_actions(_store_a(spark, sf), t.files_incoming(spark, sf)))


@register("needs_update", "J1", """
SELECT u.project, u.path, s.h IS DISTINCT FROM md5(u.content) AS needs_update
FROM files_b u LEFT JOIN (SELECT project, path, md5(content) AS h FROM files_a) s USING (project, path)
""")
def q_needs_update(spark, sf):
    return ch.needs_update(_store_a(spark, sf), t.files_b(spark, sf))


@register("orphans", "J2", """
SELECT project, path FROM files_a a WHERE project IN (SELECT project FROM files_in)
AND NOT EXISTS (SELECT 1 FROM files_in b WHERE b.project = a.project AND b.path = a.path)
""")
def q_orphans(spark, sf):
    return ch.orphans(_store_a(spark, sf), t.files_incoming(spark, sf))


_REQ = """
req AS (SELECT id, project, unnest(from_json(body, '["VARCHAR"]')) AS path FROM (
  SELECT id, project, regexp_replace(regexp_replace(trim(text), '^```[^\\n]*\\n', ''), '\\n[ \\t]*```$', '') AS body FROM selections)
  WHERE json_valid(body) AND json_type(body) = 'ARRAY')
"""


def _requests(spark, sf):
    sel = rs.parse_selection(t.selections(spark, sf))
    return sel.select("id", "project", F.explode("paths").alias("path")).where(F.col("path").isNotNull())


@register("store_get", "S16", f"""
WITH {_REQ}
SELECT r.id, r.project, r.path, f.content IS NOT NULL AS found, CAST(length(f.content) AS BIGINT) AS n_chars
FROM req r LEFT JOIN files_b f USING (project, path) WHERE r.path IS NOT NULL
""")
def q_store_get(spark, sf):
    store = sto.as_store_rows(t.files_b(spark, sf), NOW)
    g = sto.get(store, _requests(spark, sf))
    return g.select("id", "project", "path", F.col("content").isNotNull().alias("found"), F.length("content").cast("long").alias("n_chars"))


@register("store_all", "S16", "SELECT project, path, CAST(length(content) AS BIGINT) AS n_chars FROM files_b WHERE length(content) > 0")
def q_store_all(spark, sf):
    a = sto.all_files(sto.as_store_rows(t.files_b(spark, sf), NOW))
    return a.select("project", "path", F.length("content").cast("long").alias("n_chars"))


@register("store_paths", "S16", "SELECT project, path FROM files_b")
def q_store_paths(spark, sf):
    return sto.paths(sto.as_store_rows(t.files_b(spark, sf), NOW))


@register("store_clear", "S17", """
SELECT 1 AS version, count(*) AS n FROM files_a UNION ALL SELECT 2, 0 UNION ALL SELECT 3, count(*) FROM files_b
""")
def q_store_clear(spark, sf):
    """A store as change files: filled, cleared, then filled again; rows as of each version."""
    root = scratch_path(spark, "store")
    sto.append_changes(sto.as_changes(t.files_a(spark, sf), NOW, 1, "fill"), root, "fill", 1)
    sto.clear_changes(spark, root, 2)
    sto.append_changes(sto.as_changes(t.files_b(spark, sf), NOW, 3, "fill"), root, "fill", 3)
    n = [sto.latest(spark, root, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n")) for v in (1, 2, 3)]
    return n[0].unionByName(n[1]).unionByName(n[2])


@register("store_delete", "S17", f"""
WITH {_REQ}
SELECT project, count(*) AS remaining FROM files_b f
WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.project = f.project AND r.path = f.path) GROUP BY project
""")
def q_store_delete(spark, sf):
    store = sto.as_store_rows(t.files_b(spark, sf), NOW)
    left = sto.delete(store, _requests(spark, sf))
    return left.groupBy("project").agg(F.count(F.lit(1)).alias("remaining"))


@register("store_stats", "A2", """
SELECT project, count(*) AS file_count, CAST(sum(length(content)) AS BIGINT) AS total_size_bytes,
       round(sum(length(content)) / 1048576, 2) AS total_size_mb,
       count(*) FILTER (WHERE length(content) >= 1) AS vector_count
FROM files_b GROUP BY project
""")
def q_store_stats(spark, sf):
    f = t.files_b(spark, sf)
    store = sto.as_store_rows(f, NOW)
    return st.store_stats(store, vx.index_keys(f))


@register("recent_opens", "W6", """
SELECT user_id, path, epoch_us(last_opened) AS last_opened_us, rank FROM (
  SELECT user_id, path, last_opened, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_opened DESC, path) AS BIGINT) AS rank
  FROM (SELECT user_id, path, max(ts) AS last_opened FROM opens GROUP BY ALL)) WHERE rank <= 20
""")
def q_recent_opens(spark, sf):
    r = rg.recent(t.opens(spark, sf), 20)
    return r.select("user_id", "path", F.unix_micros(F.col("last_opened").cast("timestamp")).alias("last_opened_us"), "rank")


@register("latest_attributes", "W7", """
SELECT user_id, event_type, arg_max(value, ts) AS value, epoch_us(max(ts)) AS updated_us FROM events GROUP BY ALL
""")
def q_latest_attributes(spark, sf):
    a = rg.latest_attributes(t.table(spark, sf, "events"))
    return a.select("user_id", "event_type", "value", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@register("move_item", "W9", """
WITH req AS (SELECT DISTINCT f.project, f.path, CASE WHEN f.ord % 40 < 20 THEN 'up' ELSE 'down' END AS direction
             FROM files f WHERE f.ord % 200 < 60 OR EXISTS (SELECT 1 FROM queries q WHERE q.project = f.project AND contains(q.text, f.path))),
nb AS (SELECT project, path, ord, lag(path) OVER w AS prev_path, lag(ord) OVER w AS prev_ord, lead(path) OVER w AS next_path, lead(ord) OVER w AS next_ord
       FROM files WINDOW w AS (PARTITION BY project ORDER BY ord)),
sw AS (SELECT n.project, n.path AS r_path, n.ord AS r_ord,
              CASE WHEN r.direction = 'up' THEN n.prev_path ELSE n.next_path END AS o_path,
              CASE WHEN r.direction = 'up' THEN n.prev_ord ELSE n.next_ord END AS o_ord
       FROM nb n JOIN req r USING (project, path)),
ok AS (SELECT * FROM sw s WHERE o_path IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM sw x WHERE x.project = s.project AND x.o_path IS NOT NULL AND x.r_ord < s.r_ord
           AND (x.r_path IN (s.r_path, s.o_path) OR x.o_path IN (s.r_path, s.o_path)))),
pairs AS (SELECT project, r_path AS path, o_ord AS new_ord FROM ok UNION ALL SELECT project, o_path AS path, r_ord AS new_ord FROM ok)
SELECT f.project, f.path, coalesce(p.new_ord, f.ord) AS ord FROM files f LEFT JOIN pairs p USING (project, path)
""")
def q_move_item(spark, sf):
    f = t.files(spark, sf)
    # move requests: the files a question names (derived from the data)
    named = cx.name_hits(t.queries(spark, sf), f.select("project", "path", "ord"), fold=False).where("full").select("project", "path", "ord").distinct()
    # and a run of neighbours, whose requests overlap
    run = f.where(F.col("ord") % 200 < 60).select("project", "path", "ord")
    req = named.unionByName(run).select("project", "path", F.when(F.col("ord") % 40 < 20, "up").otherwise("down").alias("direction"))
    return rg.move_item(f.select("project", "path", "ord"), req)


@register("add_unique", "J15", f"""
WITH {_REQ},
c AS (SELECT project, id AS ord, CASE WHEN starts_with({{n}}, '/project/root/' || project || '/') THEN substr({{n}}, length('/project/root/' || project || '/') + 1) ELSE {{n}} END AS path
      FROM req WHERE path IS NOT NULL),
f AS (SELECT project, lower(path) AS k, arg_min(path, ord) AS path, min(ord) AS ord FROM c GROUP BY project, lower(path))
SELECT project, path, ord FROM f WHERE NOT EXISTS (SELECT 1 FROM files_a a WHERE a.project = f.project AND lower(a.path) = f.k)
""".replace("{n}", __import__("quarry.plans.sqlfrag", fromlist=["x"]).normalize("path")))
def q_add_unique(spark, sf):
    inc = _requests(spark, sf).withColumnRenamed("id", "ord")
    return rg.add_unique(t.files_a(spark, sf), inc, "/project/root/", case_insensitive=True)


_DIRS = "SELECT DISTINCT project, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM {f} WHERE suffix(path, '.json')"


@register("discover_projects", "J17", f"""
WITH d AS ({_DIRS.format(f='files_b')}), r AS ({_DIRS.format(f='files_a')})
SELECT project, dir FROM d
WHERE len(string_split(dir, '/')) < 3
  AND NOT list_has_any(string_split(dir, '/'), ['.git', '.venv', 'venv', 'node_modules', '__pycache__', '.idea', '.vscode', 'dist', 'build'])
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.project = d.project AND r.dir = d.dir)
""")
def q_discover_projects(spark, sf):
    reg = rg.config_dirs(t.files_a(spark, sf), MARKER)
    return rg.discover_projects(t.files_b(spark, sf), reg, MARKER)


@register("cleanup_missing", "J18", f"""
WITH r AS ({_DIRS.format(f='files_a')}), alive AS ({_DIRS.format(f='files_b')}),
k AS (SELECT * FROM r WHERE EXISTS (SELECT 1 FROM alive a WHERE a.project = r.project AND a.dir = r.dir)),
dr AS (SELECT project, count(*) AS dropped FROM r WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.project = r.project AND a.dir = r.dir) GROUP BY 1)
SELECT k.project, k.dir, CAST(coalesce(dr.dropped, 0) AS BIGINT) AS dropped FROM k LEFT JOIN dr USING (project)
UNION ALL SELECT project, NULL, dropped FROM dr WHERE project NOT IN (SELECT project FROM k)
""")
def q_cleanup_missing(spark, sf):
    reg = rg.config_dirs(t.files_a(spark, sf), MARKER)
    return rg.cleanup_missing(reg, t.files_b(spark, sf), MARKER)
