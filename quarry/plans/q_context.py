"""Catalog entries: stack traces, relevance and the flagship packing query."""

from quarry.operators import changes as ch
from quarry.operators import context as cx
from quarry.operators.tree import tree_rows
from quarry.plans import sql_context as sq
from quarry.plans.registry import register
from quarry.sources import tables as t

PACK_TOKENS = 20000


@register("stack_trace_files", "J9", f"""
WITH {sq.frames('asks')}
SELECT query_id AS trace_id, path, first_pos FROM hits
""")
def q_stack_trace_files(spark, sf):
    a = t.asks(spark, sf).withColumnRenamed("query_id", "trace_id")
    return cx.stack_trace_files(a, t.files(spark, sf), "trace_id", "project")


@register("crash_lines", "J10", f"""
WITH {sq.frames('asks')}
SELECT query_id AS trace_id, bn, crash_line FROM cl
""")
def q_crash_lines(spark, sf):
    a = t.asks(spark, sf).withColumnRenamed("query_id", "trace_id")
    return cx.crash_lines(a, "trace_id")


@register("relevance", "J11", f"""
WITH {sq.scored('asks')}
SELECT query_id, project, path, ord, tokens, score FROM scored WHERE score > 0
""")
def q_relevance(spark, sf):
    return cx.relevance(t.asks(spark, sf), t.files(spark, sf))


@register("mentioned_files", "J16", """
WITH j AS (SELECT q.query_id, q.project, f.path, f.ord, q.text FROM queries q JOIN files f ON f.project = q.project),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rk FROM j
        WHERE contains(text, path) OR contains(text, string_split(path, '/')[-1])) WHERE rk <= 3),
ff AS (SELECT * FROM (SELECT project, path, ord, row_number() OVER (PARTITION BY project ORDER BY ord) AS rk FROM files) WHERE rk <= 3)
SELECT query_id, project, path, CAST(rk AS BIGINT) AS rank FROM hit
UNION ALL
SELECT q.query_id, q.project, ff.path, CAST(ff.rk AS BIGINT) AS rank FROM queries q JOIN ff USING (project)
WHERE q.query_id NOT IN (SELECT query_id FROM hit)
""")
def q_mentioned_files(spark, sf):
    return cx.mentioned_files(t.queries(spark, sf), t.files(spark, sf))


@register("pack_context", "W1", sq.pack("asks", PACK_TOKENS))
def q_pack_context(spark, sf):
    return cx.pack_context(t.asks(spark, sf), t.files(spark, sf), max_tokens=PACK_TOKENS)


@register("pack_context_diff", "W2")
def q_pack_context_diff(spark, sf):
    cur = t.files_b(spark, sf)
    diffs = ch.file_diffs(t.files_a(spark, sf), cur)
    return cx.pack_context(t.asks(spark, sf), cur, max_tokens=PACK_TOKENS, diffs=diffs, time_travel=True)


@register("context_budget", "W5", """
SELECT conv_id, CAST(128000 * 0.6 AS BIGINT) AS budget, CAST(sum(length(text) // 4) AS BIGINT) AS used
FROM conversations GROUP BY conv_id
""")
def q_context_budget(spark, sf):
    from pyspark.sql import functions as F

    from quarry.functions import text as X

    c = t.table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.sum(X.tokens("text")).cast("long").alias("used")).select(
        "conv_id", cx.context_budget(128000).alias("budget"), "used")


@register("context_tree", "X14/A6", sq.TREE_ROWS)
def q_context_tree(spark, sf):
    """The trees that the context documents hold, a row per line."""
    return tree_rows(t.files(spark, sf))


@register("context_document", "X14", sq.document("asks", PACK_TOKENS))
def q_context_document(spark, sf):
    f, asks = t.files(spark, sf), t.asks(spark, sf)
    return cx.context_document(cx.pack_context(asks, f, max_tokens=PACK_TOKENS), f, asks, whole=True)


@register("context_document_diff", "X14/W2")
def q_context_document_diff(spark, sf):
    """With the diff blocks of time-travel mode."""
    cur, asks = t.files_b(spark, sf), t.asks(spark, sf)
    diffs = ch.file_diffs(t.files_a(spark, sf), cur)
    packed = cx.pack_context(asks, cur, max_tokens=PACK_TOKENS, diffs=diffs, time_travel=True)
    return cx.context_document(packed, cur, asks, diffs, time_travel=True, whole=True)
