"""DuckDB twins of the derived views in ``quarry.sources.tables``.

Each oracle query is ``WITH <views> SELECT ...``; DuckDB only evaluates the CTEs a
query references.
"""

DOC_PATH = (
    "concat(CASE doc_id % 50 WHEN 11 THEN '.git/' WHEN 12 THEN 'node_modules/' WHEN 13 THEN 'build/' ELSE '' END, "
    "lang, '/part', CAST(doc_id % 10 AS VARCHAR), '/doc_', CAST(doc_id AS VARCHAR), "
    "CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' WHEN 3 THEN '.js' "
    "WHEN 4 THEN '.json' WHEN 5 THEN '.pyc' ELSE '' END)"
)

VIEWS = {
    "files": f"SELECT source AS project, {DOC_PATH} AS path, doc_id AS ord, text AS content FROM documents",
    "files_a": "SELECT * FROM files WHERE ord % 10 <> 3",
    "files_b": (
        "SELECT project, path, ord, CASE WHEN ord % 5 = 0 THEN content || chr(10) || 'edited' ELSE content END AS content "
        "FROM files WHERE ord % 10 <> 7"
    ),
    "files_in": "SELECT * FROM files_b UNION ALL SELECT * FROM files_a WHERE ord % 40 = 7",
    "doc_paths": f"SELECT doc_id, {DOC_PATH} AS dpath, source, lang FROM documents",
    "queries": (
        "SELECT b.item_id AS query_id, coalesce(d.source, 'src0') AS project, "
        "CASE WHEN b.item_id % 4 = 0 AND d.doc_id IS NOT NULL THEN b.text || ' See ' || d.dpath || ' please.' ELSE b.text END AS text "
        "FROM benchmark b LEFT JOIN doc_paths d ON b.item_id = d.doc_id"
    ),
    "traces": (
        "SELECT doc_id AS trace_id, 'Traceback (most recent call last):' || chr(10) || '  File \"' || "
        "CASE WHEN (doc_id // 20) % 2 = 1 THEN replace('/home/u/' || dpath, '/', '\\') ELSE '/home/u/' || dpath END || "
        "'\", line ' || CAST(doc_id % 97 + 1 AS VARCHAR) || ', in f' || chr(10) || '    g()' || chr(10) || '  File \"' || "
        "'lib/doc_' || CAST(doc_id + 1 AS VARCHAR) || '.py' || '\", line 3, in g' || chr(10) || '    raise ValueError' || chr(10) || "
        "'  File \"/usr/lib/python3/json/decoder.py\", line 337, in decode' || chr(10) || 'ValueError: boom' AS text "
        "FROM doc_paths WHERE doc_id % 20 = 5"
    ),
    "responses": (
        "SELECT c.conv_id, c.turn, coalesce(d.source, 'src0') AS project, CASE "
        "WHEN c.turn % 4 = 1 THEN '<think>Looking at ' || coalesce(d.dpath, 'README.md') || ' first.</think>' || chr(10) || "
        "c.text || ' [[REF: ' || coalesce(d.dpath, 'README.md') || ']]' "
        "WHEN c.turn % 4 = 3 THEN c.text || ' [[REF: ' || coalesce(d.dpath, 'README.md') || ']]' || chr(10) || '<patch file=\"' || "
        "coalesce(d.dpath, 'README.md') || '\">print(\"conv ' || CAST(c.conv_id AS VARCHAR) || '\")' || chr(10) || '</patch>' || chr(10) || 'Done.' "
        "ELSE c.text || ' [[REF: ' || coalesce(d.dpath, 'README.md') || ']]' END AS text "
        "FROM conversations c LEFT JOIN doc_paths d ON c.turn = d.doc_id WHERE c.role = 'assistant'"
    ),
    "selections": (
        "SELECT doc_id AS id, source AS project, '```json' || chr(10) || '[\"' || dpath || '\", \"/project/root/' || source || '/' || dpath || "
        "'\", \"missing/' || dpath || '\"' || CASE WHEN doc_id % 5 = 4 THEN '' ELSE ']' END || chr(10) || '```' AS text FROM doc_paths"
    ),
    "chunks": (
        "SELECT message_id, seq, substr(text, CAST(seq * 40 + 1 AS BIGINT), 40) AS chunk, seq = n - 1 AS is_last FROM ("
        "SELECT conv_id * 1000 + turn AS message_id, text, n, unnest(range(0, n)) AS seq FROM ("
        "SELECT conv_id, turn, text, CAST(greatest(ceil(length(text) / 40), 1) AS BIGINT) AS n FROM conversations))"
    ),
    "tool_results": (
        "SELECT 'srv' || CAST(doc_id % 3 AS VARCHAR) || '__read_' || CAST(doc_id AS VARCHAR) AS name, "
        "CAST(to_json([{'text': text}, {'text': lang}]) AS VARCHAR) AS content "
        "FROM documents"
    ),
    "asks": (
        "SELECT query_id, project, text FROM queries UNION ALL "
        "SELECT trace_id + 1000000 AS query_id, d.source AS project, t.text FROM traces t JOIN documents d ON t.trace_id = d.doc_id"
    ),
    "opens": "SELECT user_id, 'p' || CAST(event_id % 50 AS VARCHAR) AS path, ts, event_id, event_type, value FROM events",
    "vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    "seeds": "SELECT id FROM vectors WHERE id % 20 = 0",
    "probes": "SELECT id, embedding FROM vectors WHERE id % 20 = 0",
}

_ORDER = list(VIEWS)


def with_views(sql: str) -> str:
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _ORDER)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH " or body[:5].upper() == "WITH\n":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
