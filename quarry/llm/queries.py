"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import fingerprints, html_text, infill, language, mixing, neardup, periodic, pieces, quality, sharding, shared_files, suffix_dedup, token_files, warc
from quarry.llm.common import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = zip(suffix_dedup.added_columns(docs), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    return suffix_dedup.remove_repeats(docs).select("doc_id", *[F.col(c).alias(name) for c, name in names])


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query
def op3_sentencepiece(spark, sf_dir):
    """Ids of every whole text, decoded again and held against the text."""
    docs = table(spark, sf_dir, "documents")
    out = pieces.encode(docs, decoded=True)
    return out.select("doc_id", "n_tokens", "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op4_warc(spark, sf_dir):
    folder = shared_files.new_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    out = warc.resolved(store(warc.read(spark, folder), "records"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op5_token_files(spark, sf_dir):
    folder = shared_files.new_folder(spark, "ids")
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder)


@query
def op6_mixing(spark, sf_dir):
    sized = mixing.cut(mixing.sizes(table(spark, sf_dir, "documents")))
    return mixing.taken(sized, mixing.plan(sized))


@query
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_minhash_neardup(spark, sf_dir):
    return neardup.link(table(spark, sf_dir, "documents"), k=4)


@query
def op8_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op9_fingerprints(spark, sf_dir):
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


@query
def op11_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op12_infill(spark, sf_dir):
    out = infill.transform(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    return infill.restore(out).withColumn("restored_sha256", F.sha2("text", 256)).drop("text")


ORACLE["op12_infill"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
k AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS k1,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS k2 FROM u),
s AS (SELECT doc_id, text, n, array_to_string(units[1:k1], '') AS a, array_to_string(units[k1 + 1:k2], '') AS b,
             array_to_string(units[k2 + 1:n], '') AS c,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


@query
def op13_periodic_runs(spark, sf_dir):
    h = F.crc32(F.col("doc_id").cast("string"))
    out = periodic.collapse(table(spark, sf_dir, "documents"), seed=F.floor(h / 10), edit=h % 10 == 0)
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    best = F.aggregate("runs", F.get("runs", F.lit(0)), periodic.more_repeated).alias("best")
    digests = F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, *digests).select(
        "doc_id",
        "n_runs",
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
