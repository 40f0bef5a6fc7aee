"""Aggregations (A1-A3, A7, A9). All grouped work uses partial (map-side)
aggregation; per-project ranking uses window group limits."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as X

# Fixed values of the project summary.
NO_EXTENSION = "(no extension)"
LINE_COUNT_EXTENSIONS = [".py", ".js", ".ts", ".md", ".txt"]
# Line boundaries of Python's str.splitlines.
LINE_BREAK_RX = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def splitlines_count(c) -> F.Column:
    """len(text.splitlines())."""
    t = F.col(c) if isinstance(c, str) else c
    norm = F.regexp_replace(t, LINE_BREAK_RX, "\n")
    breaks = F.length(norm) - F.length(F.replace(norm, F.lit("\n"), F.lit("")))
    tail = F.when((F.length(norm) > 0) & ~norm.endswith("\n"), 1).otherwise(0)
    return (breaks + tail).cast("long")


def _visible(files: DataFrame) -> DataFrame:
    return files.where(~P.is_hidden("path"))


def extension_counts(files: DataFrame, top: int | None = None) -> DataFrame:
    """A1: files per extension, ranked per project by count (ties by extension); the first
    ``top`` if given."""
    ext = F.when(P.suffix("path") == "", NO_EXTENSION).otherwise(P.suffix("path"))
    c = _visible(files).groupBy("project", ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("project").orderBy(F.desc("n"), "ext")
    r = c.withColumn("rank", F.row_number().over(w))
    r = r if top is None else r.where(F.col("rank") <= top)
    return r.withColumn("rank", F.col("rank").cast("long"))


def project_summary(files: DataFrame) -> DataFrame:
    """A1: total visible files and estimated lines over the text extensions."""
    v = _visible(files)
    is_text = P.suffix("path").isin(*LINE_COUNT_EXTENSIONS)
    return v.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(F.when(is_text, splitlines_count("content")).otherwise(0)).cast("long").alias("estimated_lines"),
    )


def store_stats(store: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """A2: count, total size (characters), MB rounded to 2, vector count."""
    s = store.groupBy("project").agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("total_size_bytes")
    ).withColumn("total_size_mb", F.round(F.col("total_size_bytes") / (1024 * 1024), 2))
    if vectors is None:
        return s.withColumn("vector_count", F.lit(0).cast("long"))
    v = vectors.groupBy("project").agg(F.count(F.lit(1)).alias("vector_count"))
    return s.join(v, "project", "left").withColumn("vector_count", F.coalesce("vector_count", F.lit(0)).cast("long"))


def snapshot_stats(files: DataFrame) -> DataFrame:
    """A3: files, characters, tokens = total chars // 4 (sum first), tiers."""
    s = files.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars")
    )
    tok = F.expr("chars DIV 4")
    return s.withColumn("tokens", tok).withColumns({
        "tier": X.context_tier("tokens"),
        "summary_tier": X.summary_tier("tokens"),
        "render_note": X.render_tier("tokens"),
        "fits_full": X.fits_full_context("tokens"),
    })


def list_dir(files: DataFrame, directory: str = "", max_dirs: int | None = None, max_files: int | None = None) -> DataFrame:
    """Non-hidden children of ``directory``: dirs (with '/') and files, each ranked by
    name; the first ``max_dirs`` and ``max_files`` if given."""
    d = directory.strip("/")
    prefix = d + "/" if d else ""
    rest = F.substring("path", len(prefix) + 1, 1 << 30) if prefix else F.col("path")
    under = files.where(F.col("path").startswith(prefix)) if prefix else files
    parts = F.split(rest, "/")
    kids = under.select(
        "project", F.element_at(parts, 1).alias("name"), F.when(F.size(parts) > 1, "dir").otherwise("file").alias("kind")
    ).where(~F.col("name").startswith(".")).distinct()
    kids = kids.withColumn("name", F.when(F.col("kind") == "dir", F.concat("name", F.lit("/"))).otherwise(F.col("name")))
    w = Window.partitionBy("project", "kind").orderBy("name")
    r = kids.withColumn("rank", F.row_number().over(w))
    for kind, most in (("dir", max_dirs), ("file", max_files)):
        if most is not None:
            r = r.where((F.col("kind") != kind) | (F.col("rank") <= most))
    return r.select("project", "kind", "name", F.col("rank").cast("long").alias("rank"))


def _doc_status(path: str, content: str | None) -> str:
    base = path.rsplit("/", 1)[-1]
    text = content or ""
    if not text.strip():
        return "empty_init" if base == "__init__.py" else "empty"
    try:
        tree = ast.parse(text)
    except Exception:  # SyntaxError, ValueError (NUL bytes), RecursionError
        return "parse_error"
    return "documented" if ast.get_docstring(tree) else "missing"


def doc_audit(files: DataFrame) -> DataFrame:
    """Module docstring status of every .py file (stdlib ``ast`` inside the
    tasks; Spark partitions the files)."""
    py = files.where(F.col("path").endswith(".py")).select("project", "path", "content")

    def run(batches):
        for pdf in batches:
            st = [_doc_status(p, c) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"project": pdf["project"], "path": pdf["path"], "status": st})

    return py.mapInPandas(run, "project string, path string, status string")


def doc_audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("project", "status").agg(F.count(F.lit(1)).alias("n"))
