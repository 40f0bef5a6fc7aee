"""Driver tables and the derived views used by the query catalog.

Views are plain DataFrame expressions over the driver tables, so their size grows
with the input. Each has a DuckDB twin in ``quarry.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the derived test views.
TRACE_ROOT = "/home/u/"
SELECTION_ROOT = "/project/root/"
CHUNK_CHARS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_path(doc_id, lang) -> F.Column:
    """Deterministic relative path of a document (see FIXTURES.md)."""
    d = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    lg = F.col(lang) if isinstance(lang, str) else lang
    prefix = (
        F.when(d % 50 == 11, ".git/")
        .when(d % 50 == 12, "node_modules/")
        .when(d % 50 == 13, "build/")
        .otherwise("")
    )
    ext = (
        F.when(d % 7 == 0, ".py")
        .when(d % 7 == 1, ".md")
        .when(d % 7 == 2, ".txt")
        .when(d % 7 == 3, ".js")
        .when(d % 7 == 4, ".json")
        .when(d % 7 == 5, ".pyc")
        .otherwise("")
    )
    return F.concat(prefix, lg, F.lit("/part"), (d % 10).cast("string"), F.lit("/doc_"), d.cast("string"), ext)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(project, path, ord, content): one row per document."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("project"),
        doc_path("doc_id", "lang").alias("path"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("content"),
    )


def files_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference snapshot."""
    return files(spark, sf_dir).where(F.col("ord") % 10 != 3)


def files_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current snapshot: some files gone, some new, every fifth edited."""
    f = files(spark, sf_dir).where(F.col("ord") % 10 != 7)
    return f.withColumn(
        "content",
        F.when(F.col("ord") % 5 == 0, F.concat("content", F.lit("\nedited"))).otherwise(F.col("content")),
    )


def files_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming sync set: the current snapshot plus a few files of the projects it
    lost entirely, so those projects are present and their other files orphaned."""
    return files_b(spark, sf_dir).unionByName(files_a(spark, sf_dir).where(F.col("ord") % 40 == 7))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(query_id, project, text): benchmark prose aimed at the project of
    document ``item_id``; every fourth query also names that document's path."""
    b = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    j = b.join(d, b.item_id == d.doc_id, "left")
    return j.select(
        F.col("item_id").alias("query_id"),
        F.coalesce(F.col("source"), F.lit("src0")).alias("project"),
        F.when(
            (F.col("item_id") % 4 == 0) & F.col("doc_id").isNotNull(),
            F.concat(F.col("text"), F.lit(" See "), doc_path("doc_id", "lang"), F.lit(" please.")),
        )
        .otherwise(F.col("text"))
        .alias("text"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traces(trace_id, text): Python tracebacks naming document files; every
    other one written with backslashes."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % 20 == 5)
    p = F.concat(F.lit(TRACE_ROOT), doc_path("doc_id", "lang"))
    p = F.when((F.col("doc_id") / 20).cast("long") % 2 == 1, F.replace(p, F.lit("/"), F.lit("\\"))).otherwise(p)
    other = F.concat(F.lit("lib/doc_"), (F.col("doc_id") + 1).cast("string"), F.lit(".py"))
    text = F.concat(
        F.lit("Traceback (most recent call last):\n  File \""),
        p,
        F.lit('", line '),
        (F.col("doc_id") % 97 + 1).cast("string"),
        F.lit(", in f\n    g()\n  File \""),
        other,
        F.lit('", line 3, in g\n    raise ValueError\n  File "/usr/lib/python3/json/decoder.py", line 337, in decode\nValueError: boom'),
    )
    return d.select(F.col("doc_id").alias("trace_id"), text.alias("text"))


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asks(query_id, project, text): the questions plus the tracebacks, each
    aimed at the project of the document it is about."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    tr = traces(spark, sf_dir).join(d, F.col("trace_id") == F.col("doc_id")).select(
        (F.col("trace_id") + 1000000).alias("query_id"), F.col("source").alias("project"), "text"
    )
    return queries(spark, sf_dir).unionByName(tr)


def _doc_paths(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id"), doc_path("doc_id", "lang").alias("dpath"), "source")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses(conv_id, turn, project, text): assistant turns citing the document whose id
    is the turn number; some wrapped with thought blocks, some carrying a patch."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    j = c.join(_doc_paths(spark, sf_dir), c.turn == F.col("doc_id"), "left")
    path = F.coalesce(F.col("dpath"), F.lit("README.md"))
    base = F.concat(F.col("text"), F.lit(" [[REF: "), path, F.lit("]]"))
    text = (
        F.when(
            F.col("turn") % 4 == 1,
            F.concat(F.lit("<think>Looking at "), path, F.lit(" first.</think>\n"), base),
        )
        .when(
            F.col("turn") % 4 == 3,
            F.concat(
                base,
                F.lit('\n<patch file="'),
                path,
                F.lit('">print("conv '),
                F.col("conv_id").cast("string"),
                F.lit('")\n</patch>\nDone.'),
            ),
        )
        .otherwise(base)
    )
    return j.select("conv_id", "turn", F.coalesce("source", F.lit("src0")).alias("project"), text.alias("text"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """selections(id, text): fenced JSON lists of three paths (relative, absolute
    under the root, and one that does not exist); every fifth one is broken."""
    d = table(spark, sf_dir, "documents")
    p = doc_path("doc_id", "lang")
    body = F.concat(
        F.lit('["'),
        p,
        F.lit('", "'),
        F.lit(SELECTION_ROOT),
        F.col("source"),
        F.lit("/"),
        p,
        F.lit('", "missing/'),
        p,
        F.lit('"'),
    )
    body = F.when(F.col("doc_id") % 5 == 4, body).otherwise(F.concat(body, F.lit("]")))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("project"),
        F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks(message_id, seq, chunk, is_last): turns cut into 40-char pieces."""
    c = table(spark, sf_dir, "conversations")
    n = F.greatest(F.ceil(F.length("text") / CHUNK_CHARS), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), n - 1)
    exploded = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        "text",
        n.alias("n"),
        F.posexplode(starts).alias("seq", "i"),
    )
    return exploded.select(
        "message_id",
        F.col("seq").cast("long").alias("seq"),
        F.expr(f"substring(text, i * {CHUNK_CHARS} + 1, {CHUNK_CHARS})").alias("chunk"),
        (F.col("seq") == F.col("n") - 1).alias("is_last"),
    )


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tool_results(name, content): JSON lists of {text} blocks."""
    d = table(spark, sf_dir, "documents")
    block = F.struct(F.col("text"))
    return d.select(
        F.concat(F.lit("srv"), (F.col("doc_id") % 3).cast("string"), F.lit("__read_"), F.col("doc_id").cast("string")).alias("name"),
        F.to_json(F.array(block, F.struct(F.col("lang").alias("text")))).alias("content"),
    )


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("path"), "ts", "event_id", "event_type", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") % 20 == 0).select("id")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") % 20 == 0).select("id", "embedding")
