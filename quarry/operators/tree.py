"""Directory tree (A6) as rows, plus its exact character length without building
the text (used by the packing budget)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.bounded import small
from quarry.session import stored

# Tree drawing glyphs.
BRANCH = "├── "
LAST = "└── "
PIPE = "│   "
BLANK = "    "
ROOT = "."


def tree_nodes(files: DataFrame, key: str = "project") -> DataFrame:
    """Distinct nodes of all path prefixes: (key, node, parts, depth, name, parent, is_last)."""
    parts = F.split(P.to_posix(F.col("path")), "/")
    pre = files.select(key, parts.alias("parts")).select(
        key, F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", 1, i))).alias("parts")
    ).distinct()
    nodes = pre.select(
        key, "parts",
        F.array_join("parts", "/").alias("node"),
        F.size("parts").alias("depth"),
        F.element_at("parts", -1).alias("name"),
        F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("parent"),
    )
    # Last sibling per parent via a partial aggregate (no per-directory window).
    last = nodes.groupBy(key, "parent").agg(F.max("name").alias("last_name"))
    return nodes.join(last, [key, "parent"]).withColumn("is_last", F.col("name") == F.col("last_name")).drop("last_name")


def tree_lines(files: DataFrame, key: str = "project") -> DataFrame:
    """One row per tree line, ``parts`` orders the lines (pre-order)."""
    nodes = tree_nodes(files, key)
    anc = nodes.select(
        key, "node", "parts",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))).alias("lvl", "anc"),
    ).where(F.col("lvl") < F.size("parts") - 1)
    flags = nodes.select(key, F.col("node").alias("anc"), F.col("is_last").alias("anc_last"))
    pref = (
        anc.join(flags, [key, "anc"])
        .groupBy(key, "node")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lvl", "anc_last"))),
                                      lambda s: F.when(s["anc_last"], BLANK).otherwise(PIPE)), "").alias("prefix"))
    )
    lines = nodes.join(pref, [key, "node"], "left").select(
        key, "parts",
        F.concat(F.coalesce("prefix", F.lit("")), F.when(F.col("is_last"), LAST).otherwise(BRANCH), "name").alias("line"),
    )
    roots = files.select(key).distinct().select(key, F.array().cast("array<string>").alias("parts"), F.lit(ROOT).alias("line"))
    return roots.unionByName(lines)


def tree_rows(files: DataFrame, key: str = "project") -> DataFrame:
    """The tree text as ordered rows (key, position, line, start_chars), a line feed between two lines.

    Lines are range-partitioned by (key, parts), so a large tree is many tasks; positions and running
    lengths are those inside a range plus what the ranges before it hold (a row per key and range)."""
    ranged = tree_lines(files, key).repartitionByRange(key, "parts").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "tree")
    size = F.length("line") + 1
    mine = Window.partitionBy(key, "range").orderBy("parts")
    inside = ranged.select(
        key, "range", "line", (F.row_number().over(mine) - 1).alias("n"), (F.sum(size).over(mine) - size).alias("chars"))
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(key, "range").agg(F.count(F.lit(1)).alias("lines"), F.sum(size).alias("size")).select(
        key, "range", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("chars0"))
    return inside.join(small(before), [key, "range"]).select(
        key, (F.col("n") + F.col("n0")).alias("position"), "line", (F.col("chars") + F.col("chars0")).alias("start_chars"))


def tree_length(files: DataFrame, key: str = "project") -> DataFrame:
    """Characters of the full tree text per key: '.' plus, per node, a newline and
    4 characters per depth level plus the name."""
    parts = F.split(P.to_posix(F.col("path")), "/")
    pre = files.select(key, parts.alias("parts")).select(
        key, F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice("parts", 1, i))).alias("parts")
    ).distinct()
    return pre.groupBy(key).agg(
        (F.lit(1) + F.sum(1 + 4 * F.size("parts") + F.length(F.element_at("parts", -1)))).cast("long").alias("tree_chars")
    )
