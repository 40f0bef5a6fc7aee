"""Gathering files.

Folders are listed in tasks, one level of the tree at a time, so that ignored folders
are never entered and names that Spark's own listing hides (``_x``, ``.x``) are seen.
Content is read in a second pass, and only that of the files that survive the filters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as X
from quarry.functions import wildcard as W
from quarry.session import checkpoint_dir

_LISTING = "rel string, is_dir boolean, length long, modified timestamp"
#: Content handed on at a time by a reading task.
READ_BATCH_BYTES = 8 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def _list_folders(root: str):
    schema = pa.schema([("rel", pa.string()), ("is_dir", pa.bool_()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC"))])

    def run(batches):
        fs, base = open_fs(root)
        for b in batches:
            for folder in b.column("rel").to_pylist():
                try:
                    found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base))
                except OSError:  # unreadable folders are skipped
                    continue
                rows = [
                    {"rel": f"{folder}/{f.base_name}" if folder else f.base_name, "is_dir": f.type == pafs.FileType.Directory,
                     "length": f.size, "modified": f.mtime}
                    for f in found if f.type in (pafs.FileType.Directory, pafs.FileType.File)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def scan_project(spark: SparkSession, root: str, ignore_patterns=()) -> DataFrame:
    """Recursive listing of non-ignored files: (path, rel, length, modified).

    One job per level of the tree; a folder that matches an ignore rule is not entered.
    """
    checkpoint_dir(spark)
    root = root.rstrip("/")
    rules = W.compile_rules(ignore_patterns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, found = spark.createDataFrame([("",)], "rel string"), None
    while True:
        level = folders.repartition(parts, "rel").mapInArrow(_list_folders(root), _LISTING)
        seen = F.when(F.col("is_dir"), F.concat("rel", F.lit("/"))).otherwise(F.col("rel"))
        level = level.where(~W.matches(seen, rules)).checkpoint(eager=True)
        files = level.where(~F.col("is_dir"))
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_dir").select("rel")
        if folders.isEmpty():
            return found.select(F.concat(F.lit(root + "/"), "rel").alias("path"), "rel", "length", "modified")


def read_files(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """The listing with ``text``: UTF-8 content, or a fixed text where a file can't be read or decoded."""
    names = listing.columns

    def run(batches):
        for b in batches:
            held, size, at = [], 0, 0
            for i, path in enumerate(b.column(names.index(path_col)).to_pylist()):
                try:
                    fs, place = open_fs(path)
                    with fs.open_input_stream(place, compression=None) as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    text = X.READ_ERROR_TEXT
                held.append(text)
                size += len(text)
                if size >= READ_BATCH_BYTES or i + 1 == b.num_rows:
                    own = b.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(held, pa.string())], names=[*names, "text"])
                    held, size, at = [], 0, i + 1

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields)
    return listing.mapInArrow(run, f"{kinds}, text string")


def read_tree(spark: SparkSession, root: str, ignore_patterns=(), extensions=None) -> DataFrame:
    """S1 + S2: list, filter on path and extension, then read the survivors only."""
    from quarry.operators.filters import ext_predicate

    listing = scan_project(spark, root, ignore_patterns)
    if extensions is not None:
        listing = listing.where(ext_predicate("rel", extensions))
    return read_files(listing)


def write_tree(files: DataFrame, root: str) -> int:
    """Writes (project, path, data binary) rows as files below ``root/project/path``; the number written."""

    def run(batches):
        for b in batches:
            for project, path, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, place = open_fs(f"{root}/{project}/{path}")
                fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(place, compression=None) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return files.select("project", "path", "data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def gather(explicit: DataFrame, discovered: DataFrame, listing: DataFrame, exclude=(), autodiscover_ext=(),
           autodiscover_py: bool = False) -> DataFrame:
    """S3: explicit list first, then autodiscovered files with the wanted
    extensions; normalized path de-duplicated keeping the first; only existing
    files; exclude spec applied; the result keeps that order in ``ord``."""
    from quarry.operators.filters import ext_predicate

    exts = list(autodiscover_ext) + ([".py"] if autodiscover_py else [])
    e = explicit.select("project", P.normalize_path("path").alias("path"), F.lit(0).alias("prio"), F.col("ord"))
    d = discovered.where(ext_predicate("path", exts) if exts else F.lit(False)).select(
        "project", P.normalize_path("path").alias("path"), F.lit(1).alias("prio"), F.col("ord"))
    u = e.unionByName(d)
    first = u.groupBy("project", "path").agg(F.min(F.struct("prio", "ord")).alias("k"))
    first = first.join(listing.select("project", "path"), ["project", "path"], "left_semi")
    rules = W.compile_rules(exclude, ())
    first = first.where(~W.matches(F.col("path"), rules))
    return first.select("project", "path", F.col("k.prio").alias("prio"), F.col("k.ord").alias("ord"))


def inject_rows(files: DataFrame, context_text: str | None, environment_text: str | None,
                context_name: str = "000_CONTEXT.md", environment_name: str = "zzz_ENVIRONMENT.md") -> DataFrame:
    """A synthetic context file first (ord = min - 1) and an environment file
    last (ord = max + 1) per project."""
    b = files.groupBy("project").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    out = files.select("project", "path", "ord", "content")
    if context_text is not None:
        out = out.unionByName(b.select("project", F.lit(context_name).alias("path"), (F.col("lo") - 1).alias("ord"),
                                       F.lit(context_text).alias("content")))
    if environment_text is not None:
        out = out.unionByName(b.select("project", F.lit(environment_name).alias("path"), (F.col("hi") + 1).alias("ord"),
                                       F.lit(environment_text).alias("content")))
    return out
