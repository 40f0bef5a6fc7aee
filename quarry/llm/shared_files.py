"""Files of the library's own formats in the session's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quarry.session import checkpoint_dir
from quarry.sources.gather import open_fs


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def written(folder: str, name: str):
    """A file that appears under its name when it is whole: a lost or repeated task leaves no half of it.

    Spark's readers pass over names that begin with a dot.
    """
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        yield f
    fs.move(part, f"{root}/{name}")


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of the files of a folder, dealt over tasks by Spark's file listing; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def paths(batches) -> Iterator[str]:
    for b in batches:
        yield from b.column("path").to_pylist()
