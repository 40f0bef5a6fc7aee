"""Catalog entries: vector search."""

from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import ivf, providers
from quarry.operators import vectors as vx
from quarry.plans.registry import register
from quarry.session import scratch_path
from quarry.sources import store as sto
from quarry.sources import tables as t

TOP_K = 10
MIN_SCORE = 0.2
_COS = ("CASE WHEN len({a}) <> len({b}) THEN 0.0 WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
        "ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END")


def cos(a, b):
    return f"round({_COS.format(a=a, b=b)}, 6)"


@register("cosine_pairs", "V1", f"""
SELECT a.id, b.id AS next_id, {cos('a.embedding', 'b.embedding')} AS score FROM vectors a JOIN vectors b ON b.id = a.id + 1
""")
def q_cosine_pairs(spark, sf):
    v = t.vectors(spark, sf)
    b = v.select(F.col("id").alias("next_id"), F.col("embedding").alias("e2"))
    return v.join(b, F.col("next_id") == F.col("id") + 1).select("id", "next_id", F.round(V.cosine("embedding", "e2"), 6).alias("score"))


@register("normalize_vectors", "V2", """
SELECT id, list_transform(embedding, lambda x: round(CASE WHEN list_dot_product(embedding, embedding) = 0 THEN x
       ELSE x / sqrt(list_dot_product(embedding, embedding)) END, 6)) AS unit FROM vectors
""")
def q_normalize_vectors(spark, sf):
    v = t.vectors(spark, sf)
    return v.select("id", F.transform(V.normalize("embedding"), lambda x: F.round(x, 6)).alias("unit"))


_TOPK = """
SELECT probe_id, id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM (
    SELECT p.id AS probe_id, v.id, {cos} AS score FROM {probes} p JOIN vectors v ON {cond}) WHERE score >= {min})
WHERE rank <= {k}
"""


def topk_sql(probes, k, min_score, exclude_self=False):
    return _TOPK.format(cos=cos("p.embedding", "v.embedding"), probes=probes, cond="p.id <> v.id" if exclude_self else "true",
                        min=min_score, k=k)


@register("search_topk", "V4", topk_sql("probes", TOP_K, MIN_SCORE))
def q_search_topk(spark, sf):
    p = t.probes(spark, sf).withColumnRenamed("id", "probe_id")
    return vx.search(p, t.vectors(spark, sf), TOP_K, MIN_SCORE)


@register("related_items", "V5", topk_sql("(SELECT v.* FROM vectors v JOIN seeds USING (id))", 5, MIN_SCORE, True)
          .replace("probe_id", "seed_id"))
def q_related_items(spark, sf):
    return vx.related(t.seeds(spark, sf), t.vectors(spark, sf), 5, MIN_SCORE)


_EXPAND = f"""
WITH r AS ({topk_sql("(SELECT v.* FROM vectors v JOIN seeds USING (id))", 3, MIN_SCORE, True)})
SELECT id, max(score) AS score FROM r WHERE id NOT IN (SELECT id FROM seeds) GROUP BY id ORDER BY score DESC, id LIMIT 6
"""


@register("expand_selection", "V6", _EXPAND)
def q_expand_selection(spark, sf):
    return vx.expand_selection(t.seeds(spark, sf), t.vectors(spark, sf), 3, MIN_SCORE)


@register("keep_set", "O2", f"""
WITH s AS ({_EXPAND})
SELECT DISTINCT id FROM (SELECT id FROM seeds UNION SELECT id FROM s) WHERE id IN (SELECT id FROM vectors)
""")
def q_keep_set(spark, sf):
    v = t.vectors(spark, sf)
    sd = t.seeds(spark, sf)
    return vx.keep_set(sd, vx.expand_selection(sd, v, 3, MIN_SCORE), v)


def _index_rows(index, *keys):
    """What SQL can say of an index: keys, size, length and norm of the vector."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return index.select(*keys, "size", F.size("embedding").cast("long").alias("dims"), F.round(norm, 6).alias("norm"))


_INDEX = "SELECT project, path, CAST(length(content) AS BIGINT) AS size, CAST(64 AS BIGINT) AS dims, CAST(1.0 AS DOUBLE) AS norm FROM {} WHERE length(content) > 0"


@register("build_index", "V3/U1", _INDEX.format("files"))
def q_build_index(spark, sf):
    return _index_rows(vx.build_index(t.files(spark, sf)), "project", "path")


def _inverted_lists(spark, sf):
    """The index of all vectors, written and read again."""
    path = scratch_path(spark, "ivf")
    ivf.build(t.vectors(spark, sf), path, top_k=TOP_K)
    return path


@register("approx_search", "V7")
def q_approx_search(spark, sf):
    p = t.probes(spark, sf).withColumnRenamed("id", "probe_id")
    return ivf.search(p, _inverted_lists(spark, sf), TOP_K, MIN_SCORE)


@register("approx_lists", "V7", "SELECT id, true AS listed_once, true AS near_unit FROM vectors WHERE list_dot_product(embedding, embedding) > 0")
def q_approx_lists(spark, sf):
    """Every vector is in one list, and its code gives it back up to the error stated."""
    path = _inverted_lists(spark, sf)
    rows = spark.read.parquet(f"{path}/lists").groupBy("id").agg(F.count("*").alias("n"), F.max("error").alias("error"))
    return rows.select("id", (F.col("n") == 1).alias("listed_once"), (F.col("error") < 0.05).alias("near_unit"))


@register("approx_recall", "V7", """
SELECT id AS probe_id, true AS enough_found, true AS few_compared FROM probes
""")
def q_approx_recall(spark, sf):
    """Over all probes: at least 0.9 of the exact hits found, under 0.15 of the corpus compared exactly."""
    p = t.probes(spark, sf).withColumnRenamed("id", "probe_id")
    v = t.vectors(spark, sf)
    path = _inverted_lists(spark, sf)
    found = vx.recall(ivf.search(p, path, TOP_K, MIN_SCORE), vx.search(p, v, TOP_K, MIN_SCORE))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    rows = found.join(ivf.compared(p, path, TOP_K, MIN_SCORE), "probe_id", "left")
    total = rows.agg(F.avg("recall").alias("recall"), F.sum("compared").alias("compared"), F.count("*").alias("probes"))
    total = total.join(F.broadcast(n)).select((F.col("recall") >= 0.9).alias("enough_found"), (F.col("compared") < 0.15 * F.col("probes") * F.col("n")).alias("few_compared"))
    return p.select("probe_id").join(F.broadcast(total))  # one row of totals


def _unavailable():
    raise ConnectionError


def _choosy():
    """Counts letters; refuses short texts one by one and long batches as a whole."""
    def embed(texts):
        if any(len(x) % 3 == 0 for x in texts):
            raise ValueError
        return [None if len(x) % 5 == 0 else [len(x), x.count("a"), x.count("e")] for x in texts]

    return embed


def _last():
    return lambda texts: [[x.count("i"), x.count("o")] if x.count("a") % 2 == 0 else None for x in texts]


@register("embed_chain", "U1", """
WITH f AS (SELECT project, path, content, length(content) AS n, length(content) - length(replace(content, 'a', '')) AS a,
                  length(content) - length(replace(content, 'e', '')) AS e, length(content) - length(replace(content, 'i', '')) AS i,
                  length(content) - length(replace(content, 'o', '')) AS o FROM files WHERE content IS NOT NULL)
SELECT project, path, CASE WHEN n % 3 <> 0 AND n % 5 <> 0 THEN 'choosy' WHEN a % 2 = 0 THEN 'last' END AS provider,
       CASE WHEN n % 3 <> 0 AND n % 5 <> 0 THEN [CAST(n AS DOUBLE), a, e] WHEN a % 2 = 0 THEN [CAST(i AS DOUBLE), o] END AS embedding,
       CASE WHEN n % 3 <> 0 AND n % 5 <> 0 THEN ['down: ConnectionError'] WHEN n % 3 = 0 THEN ['down: ConnectionError', 'choosy: ValueError']
            ELSE ['down: ConnectionError', 'choosy: no vector'] END || CASE WHEN (n % 3 = 0 OR n % 5 = 0) AND a % 2 = 1 THEN ['last: no vector'] ELSE [] END AS failures
FROM f
""")
def q_embed_chain(spark, sf):
    """A provider that cannot be set up, one that fails on some texts, and one that has no vector for some."""
    chain = [("down", _unavailable), ("choosy", _choosy), ("last", _last)]
    return providers.embed_files(t.files(spark, sf).where("content IS NOT NULL"), chain)


@register("sync_index", "V8", f"{_INDEX.format('files_b')} UNION ALL {_INDEX.format('files_a')} AND project NOT IN (SELECT project FROM files_b)")
def q_sync_index(spark, sf):
    a, b = t.files_a(spark, sf), t.files_b(spark, sf)
    acts = sto.sync_actions(sto.as_store_rows(a, "2024-01-01"), b)
    return _index_rows(vx.sync_index(vx.build_index(a), acts, b), "project", "path")


LETTERS = "etaoinsr"  # of the plugged-in embedding whose values SQL can restate


def _letters(text):
    """Counts of eight letters: a plug-in embedding."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])


def _millionths(index, *keys):
    return index.select(*keys, "size", F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("long")).alias("millionths"))


def _counts_sql(x):
    return "CAST([" + ", ".join(f"length({x}) - length(replace({x}, '{c}', ''))" for c in LETTERS) + "] AS DOUBLE[])"


def _letters_sql(keys, path, content, src):
    return (f"SELECT {keys}, size, list_transform(v, lambda a: CAST(round(a / sqrt(list_dot_product(v, v)) * 1000000) AS BIGINT)) AS millionths FROM "
            f"(SELECT *, {_counts_sql('x')} AS v FROM (SELECT {keys}, CAST(length({content}) AS BIGINT) AS size, "
            f"'File: ' || {path} || chr(10) || chr(10) || {content} AS x FROM {src} WHERE length({content}) > 0))")


@register("index_values", "V3/U1", _letters_sql("project, path", "path", "content", "files"))
def q_index_values(spark, sf):
    """An index of a plugged-in embedding, the vectors compared by value."""
    return _millionths(vx.build_index(t.files(spark, sf), _letters), "project", "path")


@register("sync_index_values", "V8", _letters_sql("project, path", "path", "content", "files_b") + " UNION ALL "
          + _letters_sql("project, path", "path", "content", "(SELECT * FROM files_a WHERE project NOT IN (SELECT project FROM files_b))"))
def q_sync_index_values(spark, sf):
    """Vectors after a sync: edited files have those of their new text."""
    a, b = t.files_a(spark, sf), t.files_b(spark, sf)
    acts = sto.sync_actions(sto.as_store_rows(a, "2024-01-01"), b)
    return _millionths(vx.sync_index(vx.build_index(a, _letters), acts, b, _letters), "project", "path")


@register("conversation_index_values", "V9", _letters_sql("id, conv_id, turn, role", "id", "text", "(SELECT *, concat_ws('/', conv_id, turn) AS id FROM conversations)"))
def q_conversation_index_values(spark, sf):
    return _millionths(vx.conversation_index(t.table(spark, sf, "conversations"), _letters), "id", "conv_id", "turn", "role")


@register("conversation_search_values", "V9", f"""
WITH p AS (SELECT query_id AS probe_id, {_counts_sql('text')} AS a FROM queries),
v AS (SELECT id, {_counts_sql("('File: ' || id || chr(10) || chr(10) || text)")} AS b FROM (
      SELECT *, concat_ws('/', conv_id, turn) AS id FROM conversations WHERE role = 'user' AND conv_id % 2 = 0 AND length(text) > 0)),
s AS (SELECT probe_id, id, round(CASE WHEN list_dot_product(a, a) = 0 THEN 0 ELSE list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) END, 6) AS score
      FROM p, v)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM s WHERE score >= 0.9) WHERE rank <= 5
""")
def q_conversation_search_values(spark, sf):
    """User turns of the even conversations nearest to each question, by the plugged-in embedding."""
    c = t.table(spark, sf, "conversations")
    q = t.queries(spark, sf).select(F.col("query_id").alias("probe_id"), "text")
    probes = vx.embed_texts(q, "text", embed=_letters).select("probe_id", "embedding")
    even = c.where(F.col("conv_id") % 2 == 0).select("conv_id")
    found = vx.search_conversations(probes, vx.conversation_index(c, _letters), 5, 0.9, ["user"], even)
    return found.select("probe_id", "id", "score", "rank")


def _questions(spark, sf):
    q = t.queries(spark, sf).select(F.col("query_id").alias("probe_id"), "text")
    return vx.embed_texts(q, "text").select("probe_id", "embedding")


@register("conversation_search", "V9")
def q_conversation_search(spark, sf):
    return vx.search_conversations(_questions(spark, sf), vx.conversation_index(t.table(spark, sf, "conversations")), 5, 0.0)


@register("conversation_index", "V9", """
SELECT concat_ws('/', conv_id, turn) AS id, conv_id, role, CAST(length(text) AS BIGINT) AS size, CAST(64 AS BIGINT) AS dims, CAST(1.0 AS DOUBLE) AS norm
FROM conversations WHERE length(text) > 0
""")
def q_conversation_index(spark, sf):
    return _index_rows(vx.conversation_index(t.table(spark, sf, "conversations")), "id", "conv_id", "role")


@register("conversation_search_filtered", "V9")
def q_conversation_search_filtered(spark, sf):
    """User turns of the even conversations."""
    c = t.table(spark, sf, "conversations")
    even = c.where(F.col("conv_id") % 2 == 0).select("conv_id")
    return vx.search_conversations(_questions(spark, sf), vx.conversation_index(c), 5, 0.0, ["user"], even)


@register("rehydrate_hits", "J12", f"""
WITH hits AS ({topk_sql("probes", TOP_K, MIN_SCORE)})
SELECT h.probe_id, f.project, f.path, round(h.score, 6) AS score, CAST(length(f.content) AS BIGINT) AS n_chars
FROM hits h JOIN files f ON f.ord = h.id WHERE length(f.content) > 0
""")
def q_rehydrate_hits(spark, sf):
    p, f = t.probes(spark, sf).withColumnRenamed("id", "probe_id"), t.files(spark, sf)
    hits = vx.search(p, t.vectors(spark, sf), TOP_K, MIN_SCORE).join(f.select("project", "path", F.col("ord").alias("id")), "id")
    hits = hits.select("probe_id", "project", "path", (1 - F.col("score")).alias("distance"))
    out = vx.rehydrate(hits, sto.as_store_rows(f, "2024-01-01"))
    return out.select("probe_id", "project", "path", F.round("score", 6).alias("score"), F.length("content").cast("long").alias("n_chars"))


@register("index_roundtrip", "S18", "SELECT id, embedding, label FROM vectors")
def q_index_roundtrip(spark, sf):
    path = scratch_path(spark, "index")
    sto.save_index(t.vectors(spark, sf), path)
    return sto.load_index(spark, path)
