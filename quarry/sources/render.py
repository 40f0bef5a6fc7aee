"""Renderings (S12-S14): markdown snapshot and marked plain text.

Documents are produced as ordered rows (one block per file, plus head and tail
rows), never as one string per project: a writer sorts within range partitions
of ``(project, ord)`` and streams the text out, so a huge project is spread over
many tasks and files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.bounded import small
from quarry.operators import secrets as se
from quarry.operators.tree import tree_lines
from quarry.session import stored
from quarry.sources import archive as ar

CHUNK_CHARS = 10000
TREE_INTRO = "CONTEXT: PROJECT STRUCTURE\nBelow is the file tree. Use this to understand module relationships.\n\n"


def markdown_blocks(files: DataFrame) -> DataFrame:
    """S12 per-file blocks: heading, fenced code tagged by extension (scrubbed)."""
    return _blocks(se.scrub(files))


def _blocks(s: DataFrame) -> DataFrame:
    block = F.concat(F.lit("### `"), "path", F.lit("`\n```"), X.fence_lang("path"), F.lit("\n"), "content", F.lit("\n```\n"))
    return s.select("project", "ord", "path", block.alias("block"))


def markdown_document(files: DataFrame, title_of=None) -> DataFrame:
    """S12 whole document as ordered rows (project, sec, k1, k2, text):
    title + tree (sec 0), file blocks (sec 1), archive block comment (sec 2)."""
    title = files.select("project").distinct().select(
        "project", F.lit(0).alias("sec"), F.lit(0).cast("long").alias("k1"), F.array().cast("array<string>").alias("k2"),
        F.concat(F.lit("# Codebase Snapshot: "), F.coalesce(title_of, F.col("project")) if title_of is not None else F.col("project"),
                 F.lit("\n\n## Project Structure\n```text")).alias("text"))
    tl = tree_lines(files).select("project", F.lit(0).alias("sec"), F.lit(1).cast("long").alias("k1"), F.col("parts").alias("k2"), F.col("line").alias("text"))
    mid = files.select("project").distinct().select(
        "project", F.lit(0).alias("sec"), F.lit(2).cast("long").alias("k1"), F.array().cast("array<string>").alias("k2"),
        F.lit("```\n\n## File Contents\n").alias("text"))
    scrubbed = stored(se.scrub(files), "scrubbed")
    blocks = _blocks(scrubbed).select("project", F.lit(1).alias("sec"), F.col("ord").alias("k1"),
                                           F.array().cast("array<string>").alias("k2"), F.col("block").alias("text"))
    arch = ar.pack(scrubbed, redact=False).select("project", F.lit(2).alias("sec"), F.col("shard").cast("long").alias("k1"), F.array().cast("array<string>").alias("k2"),
                                 F.concat(F.lit("\n<!--\n"), "block", F.lit("\n-->")).alias("text"))
    return title.unionByName(tl).unionByName(mid).unionByName(blocks).unionByName(arch)


def write_document(doc: DataFrame, out_dir: str) -> None:
    """Stream the ordered rows to text files per project (range partitions keep
    each file a contiguous, ordered piece of the document)."""
    (doc.repartitionByRange("project", "sec", "k1").sortWithinPartitions("project", "sec", "k1", "k2")
        .select("project", "text").write.mode("overwrite").partitionBy("project").text(out_dir))


def marked_chunks(files: DataFrame, chunk: int = CHUNK_CHARS) -> DataFrame:
    """START_FILE header, sanitized content in 10,000-character chunks,
    END_FILE footer: rows (project, ord, part, text)."""
    s = se.scrub(files).withColumn("clean", X.glyph_filter("content"))
    n = F.greatest(F.ceil(F.length("clean") / chunk), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("clean", i * chunk + 1, F.lit(chunk)))
    head = F.concat(F.lit("\n--- START_FILE: "), "path", F.lit(" ---\n"))
    parts = F.concat(F.array(head), pieces, F.array(F.lit("\n--- END_FILE ---\n")))
    return s.select("project", "ord", F.posexplode(parts).alias("part", "text")).withColumn("part", F.col("part").cast("long"))


def batch_export(files: DataFrame, projects: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Writes the marked text of every requested project below ``out_dir`` and gives one
    status row per project: 'ok' if its text is there in full when it is read back, 'failed' if
    not, 'empty' if it has nothing to export. Without ``out_dir`` nothing is written, and 'ok'
    says that there is something to export."""
    wanted = projects.select("project").distinct()
    st = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).cast("long").alias("chars"))
    j = wanted.join(st, "project", "left")
    out = j.select("project", F.when(F.col("files").isNull(), "empty").otherwise("ok").alias("status"),
                   F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"),
                   F.expr("coalesce(chars, 0) DIV 4").alias("tokens"))
    if out_dir is not None:
        mine = files.join(small(wanted), "project", "left_semi")
        text = stored(marked_chunks(mine).select("project", F.lit(0).alias("sec"), F.col("ord").alias("k1"), F.col("part").alias("k2"), "text"), "marked")
        write_document(text, out_dir)
        meant = text.groupBy("project").agg(F.sum(F.length("text") + 1).alias("meant"))  # a line feed ends each row
        there = meant.join(exported(files.sparkSession, out_dir), "project", "left").select("project", (F.col("meant") == F.coalesce(F.col("chars"), F.lit(0))).alias("whole"))
        failed = F.coalesce(~F.col("whole"), F.lit(True)) & (F.col("status") == "ok")
        out = out.join(there, "project", "left").withColumn("status", F.when(failed, "failed").otherwise(F.col("status"))).drop("whole")
    return out


def exported(spark: SparkSession, out_dir: str) -> DataFrame:
    """(project, chars) of what an export wrote: a row per project, its text lines rejoined by length."""
    t = spark.read.schema("value string, project string").option("lineSep", "\n").text(out_dir)
    return t.groupBy("project").agg(F.sum(F.length("value") + 1).alias("chars"))
