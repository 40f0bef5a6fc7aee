"""Path expressions (X1, P9-P11) built from Spark SQL string/array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that a project search passes over.
SKIP_DIRS = [".git", ".venv", "venv", "node_modules", "__pycache__", ".idea", ".vscode", "dist", "build"]

# Extension regex with Python ``os.path.splitext`` semantics: leading dots of the
# base name never start an extension. Valid in both Java regex and RE2.
SPLITEXT_RX = r"^\.*[^.].*(\.[^.]*)$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_posix(c) -> Column:
    return F.replace(_c(c), F.lit("\\"), F.lit("/"))


def normalize_path(c) -> Column:
    """posixpath.normpath after turning backslashes into slashes.

    ``.`` and empty segments vanish, ``..`` pops the previous segment (kept when the
    path is relative and nothing is left to pop, dropped at an absolute root).
    """
    p = to_posix(c)
    absolute = p.startswith("/")
    parts = F.split(p, "/")

    def step(acc, x):
        last = F.element_at(acc, -1)
        pop = (F.size(acc) > 0) & (last != F.lit(".."))
        return (
            F.when((x == "") | (x == "."), acc)
            .when(
                x == "..",
                F.when(pop, F.slice(acc, 1, F.size(acc) - 1))
                .when(absolute, acc)
                .otherwise(F.array_append(acc, x)),
            )
            .otherwise(F.array_append(acc, x))
        )

    segs = F.aggregate(parts, F.array().cast("array<string>"), step)
    body = F.array_join(segs, "/")
    return (
        F.when(absolute, F.concat(F.lit("/"), body))
        .when(body == "", F.lit("."))
        .otherwise(body)
    )


def basename(c) -> Column:
    return F.element_at(F.split(to_posix(c), "/"), -1)


def suffix(c) -> Column:
    """os.path.splitext(path)[1] of the base name ('' when none)."""
    return F.regexp_extract(basename(c), SPLITEXT_RX, 1)


def parent(c) -> Column:
    p = to_posix(c)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))


def depth(c) -> Column:
    return F.size(F.split(to_posix(c), "/"))


def is_hidden(c) -> Column:
    """Some component of the relative path starts with a dot."""
    return F.exists(F.split(to_posix(c), "/"), lambda x: x.startswith("."))


def restore_unsafe(c) -> Column:
    """P10 for restore: normalized path escapes the root or is absolute."""
    n = normalize_path(c)
    return n.startswith("..") | n.startswith("/") | F.regexp_like(n, F.lit(r"^[A-Za-z]:"))


def patch_unsafe(c) -> Column:
    """P10 for patches: any '..', or a leading slash/backslash."""
    p = _c(c)
    return p.contains("..") | p.startswith("/") | p.startswith("\\")
