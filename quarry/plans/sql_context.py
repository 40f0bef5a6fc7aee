"""DuckDB SQL for the context operators."""

from quarry.plans import sqlfrag as q

FRAMES = """
fr AS (
  SELECT query_id, project, generate_subscripts(raws, 1) - 1 AS pos, replace(unnest(raws), '\\', '/') AS clean,
         CAST(unnest(lines) AS BIGINT) AS line
  FROM (SELECT query_id, project, regexp_extract_all(text, 'File "(.*?)", line (\\d+)', 1) AS raws,
               regexp_extract_all(text, 'File "(.*?)", line (\\d+)', 2) AS lines FROM {src})),
sfx AS (
  SELECT * FROM (SELECT query_id, project, pos, i, array_to_string(parts[i:], '/') AS path
                 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, string_split(clean, '/') AS parts FROM fr)))
  WHERE path <> ''),
bp AS (SELECT project, path, min(ord) AS ord FROM {files} GROUP BY ALL),
bnm AS (SELECT project, {bn} AS bn, arg_min(path, ord) AS path, min(ord) AS ord FROM {files} GROUP BY ALL),
cands AS (
  SELECT s.query_id, s.pos, b.path, b.ord, CASE WHEN s.i = 1 THEN 1 ELSE 2 END AS tier FROM sfx s JOIN bp b USING (project, path)
  UNION ALL
  SELECT f.query_id, f.pos, b.path, b.ord, 3 AS tier FROM fr f JOIN bnm b ON f.project = b.project AND string_split(f.clean, '/')[-1] = b.bn),
best AS (SELECT query_id, pos, arg_min(path, tier * 1000000000000 + ord) AS path FROM cands GROUP BY ALL),
hits AS (SELECT query_id, path, CAST(min(pos) AS BIGINT) AS first_pos FROM best GROUP BY ALL),
cl AS (SELECT query_id, string_split(clean, '/')[-1] AS bn, arg_max(line, pos) AS crash_line FROM fr GROUP BY ALL),
prio AS (
  SELECT h.query_id, a.project, h.path, f.ord, h.first_pos, cl.crash_line, CAST(length(f.content) // 4 + 20 AS BIGINT) AS cost
  FROM hits h JOIN {src} a USING (query_id) JOIN {files} f ON f.project = a.project AND f.path = h.path
  LEFT JOIN cl ON cl.query_id = h.query_id AND cl.bn = {hbn})
""".replace("{bn}", q.basename("path")).replace("{hbn}", q.basename("h.path"))


def frames(src: str, files: str = "files") -> str:
    return FRAMES.replace("{src}", src).replace("{files}", files)


SCORED = f"""
qt AS (SELECT query_id, project, lower(text) AS lq,
              list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda t: length(t) >= 4)) AS terms FROM {{src}}),
scored AS (
  SELECT q.query_id, f.project, f.path, f.ord, CAST(length(f.content) // 4 AS BIGINT) AS tokens,
         CAST((CASE WHEN contains(q.lq, lower(f.path)) THEN 50 WHEN contains(q.lq, lower({q.basename('f.path')})) THEN 30 ELSE 0 END)
              + len(list_filter(q.terms, lambda t: contains(lower(f.content), t))) AS BIGINT) AS score
  FROM qt q JOIN {{files}} f ON f.project = q.project)
"""


def scored(src: str, files: str = "files") -> str:
    return SCORED.replace("{src}", src).replace("{files}", files)


TREE_LINES = """
tn AS (SELECT DISTINCT project, parts[1:i] AS p FROM (SELECT project, parts, unnest(range(1, len(parts) + 1)) AS i
       FROM (SELECT project, string_split(path, '/') AS parts FROM files))),
tl AS (SELECT project, p, p = max(p) OVER (PARTITION BY project, p[1:len(p) - 1]) AS is_last FROM tn),
tw AS (SELECT a.project, a.p, a.is_last, coalesce(string_agg(CASE WHEN b.is_last THEN '    ' WHEN NOT b.is_last THEN '│   ' END, '' ORDER BY len(b.p)), '') AS prefix
       FROM tl a LEFT JOIN tl b ON b.project = a.project AND len(b.p) < len(a.p) AND a.p[1:len(b.p)] = b.p GROUP BY ALL)
"""

TREE_ROWS = "WITH " + TREE_LINES.strip() + """,
lines AS (SELECT project, p, prefix || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || p[-1] AS line FROM tw
          UNION ALL SELECT DISTINCT project, CAST([] AS VARCHAR[]), '.' FROM files)
SELECT project, row_number() OVER w - 1 AS position, line, CAST(sum(length(line) + 1) OVER w - length(line) - 1 AS BIGINT) AS start_chars
FROM lines WINDOW w AS (PARTITION BY project ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

#: As many lines of the tree as a row of the document has (``operators.context.TREE_BLOCK``).
DOCUMENT = "," + TREE_LINES.rstrip() + """,
tree_lines AS (SELECT project, p, prefix || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || p[-1] AS line FROM tw
               UNION ALL SELECT DISTINCT project, CAST([] AS VARCHAR[]), '.' FROM files),
tree_blocks AS (SELECT project, k // 256 AS block, string_agg(line || chr(10), '' ORDER BY k) AS text
                FROM (SELECT project, line, row_number() OVER (PARTITION BY project ORDER BY p) - 1 AS k FROM tree_lines) GROUP BY ALL),
blocks AS (
  SELECT k.query_id, CASE WHEN k.kind = 'priority' THEN 2 ELSE 3 END AS section, CASE WHEN k.kind = 'priority' THEN k.first_pos ELSE -k.score END AS pos, k.ord,
         CASE WHEN k.crash_line IS NOT NULL THEN '!!! CRASH DETECTED IN ' || k.path || ' AT LINE ' || k.crash_line || ' !!!' || chr(10) ELSE '' END
         || '=== FILE: ' || k.path || ' ===' || chr(10) || f.content || chr(10) || chr(10) AS text
  FROM packed k JOIN files f USING (project, path)),
parts AS (
  SELECT query_id, 0 AS section, 0 AS position, 'PROJECT ARCHITECTURE:' || chr(10) AS text, 22 AS chars FROM {src}
  UNION ALL
  SELECT a.query_id, 0, 1 + b.block, b.text, length(b.text) FROM {src} a JOIN tree_blocks b USING (project)
  UNION ALL
  SELECT query_id, 0, 1 + n, text, length(text) FROM (
    SELECT a.query_id, coalesce(max(b.block) + 1, 0) AS n, CASE WHEN count(b.block) > 0 THEN chr(10) ELSE chr(10) || chr(10) END AS text
    FROM {src} a LEFT JOIN tree_blocks b USING (project) GROUP BY a.query_id)
  UNION ALL
  SELECT query_id, 1, 1, note, length(note) FROM (SELECT DISTINCT query_id, '--- ACTIVE DEBUGGING CONTEXT (PRIORITY) ---' || chr(10)
    || '!!! THE USER IS DEBUGGING A CRASH !!!' || chr(10) || chr(10) AS note FROM blocks WHERE section = 2)
  UNION ALL
  SELECT query_id, section, row_number() OVER (PARTITION BY query_id, section ORDER BY pos, ord) - 1, text, length(text) FROM blocks)
SELECT query_id, a.project, section, CAST(position AS BIGINT) AS position, parts.text, CAST(chars AS BIGINT) AS chars,
       CAST(coalesce(sum(chars) OVER (PARTITION BY query_id ORDER BY section, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_chars
FROM parts JOIN {src} a USING (query_id)
"""


TREE = """
tnodes AS (SELECT DISTINCT project, parts[1:i] AS p
           FROM (SELECT project, parts, unnest(range(1, len(parts) + 1)) AS i
                 FROM (SELECT project, string_split(replace(path, '\\', '/'), '/') AS parts FROM {files}))),
tree AS (SELECT project, CAST(1 + sum(1 + 4 * len(p) + length(p[-1])) AS BIGINT) AS tree_chars FROM tnodes GROUP BY project)
"""


def tree(files: str = "files") -> str:
    return TREE.replace("{files}", files)


def pack(src: str, max_tokens: int, files: str = "files", diff_cte: str | None = None, time_travel: bool = False,
         final: tuple[str, str] = ("", "")) -> str:
    extra = "+ coalesce(d.diff_tokens, 0)" if diff_cte else ""
    djoin = "LEFT JOIN dt d ON d.project = s.project AND d.path = s.path" if diff_cte else ""
    tt = 20 if time_travel else 0
    return f"""WITH RECURSIVE {frames(src, files)}, {scored(src, files)}, {tree(files)},
{diff_cte + ',' if diff_cte else ''}
base AS (
  SELECT a.query_id, {max_tokens} - coalesce((22 + t.tree_chars + 2) // 4, 0) - {tt} - coalesce(pc.prio_cost, 0) AS rem0
  FROM {src} a LEFT JOIN tree t USING (project)
  LEFT JOIN (SELECT query_id, sum(cost) AS prio_cost FROM prio GROUP BY 1) pc USING (query_id)),
cand AS (
  SELECT s.query_id, s.project, s.path, s.ord, s.score, CAST(s.tokens + 20 {extra} AS BIGINT) AS cost,
         row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.ord) AS rk
  FROM scored s {djoin}
  WHERE NOT EXISTS (SELECT 1 FROM prio p WHERE p.query_id = s.query_id AND p.path = s.path)),
rec(query_id, rk, rem, took) AS (
  SELECT query_id, CAST(0 AS BIGINT), rem0, false FROM base WHERE rem0 > 0
  UNION ALL
  SELECT c.query_id, c.rk, CASE WHEN c.cost < r.rem THEN r.rem - c.cost ELSE r.rem END, c.cost < r.rem
  FROM rec r JOIN cand c ON c.query_id = r.query_id AND c.rk = r.rk + 1)
{final[0]}SELECT query_id, project, path, ord, CAST(NULL AS BIGINT) AS score, cost, 'priority' AS kind, crash_line, first_pos FROM prio
UNION ALL
SELECT c.query_id, c.project, c.path, c.ord, c.score, c.cost, 'scored' AS kind, CAST(NULL AS BIGINT) AS crash_line, CAST(NULL AS BIGINT) AS first_pos
FROM rec r JOIN cand c USING (query_id, rk) WHERE r.took{final[1]}
"""


def document(src: str, max_tokens: int) -> str:
    return pack(src, max_tokens, final=(", packed AS (", ")" + DOCUMENT.replace("{src}", src).strip()))
