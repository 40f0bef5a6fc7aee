"""Snapshot comparison.

Comparisons join on ``(project, path)``. Only a 32-char md5 and the length cross the
shuffle, never the content, except for the diff operator that needs both texts.
The key is unique per file, so a project holding a third of all rows still
spreads over every shuffle partition.
"""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.bounded import small

KEYS = ["project", "path"]


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """J6 ``save_fingerprints``: path -> md5 ('' when the content is unreadable)."""
    return files.select(*KEYS, F.coalesce(F.md5(content), F.lit("")).alias("md5"))


def _digest(files: DataFrame) -> DataFrame:
    return files.select(*KEYS, F.md5("content").alias("h"), F.length("content").alias("n"))


def compare_fingerprints(ref: DataFrame, cur: DataFrame, include_same: bool = False) -> DataFrame:
    """Added / removed / modified from stored md5 fingerprints."""
    r = ref.select(*KEYS, F.col("md5").alias("h_ref"), F.lit(True).alias("in_ref"))
    c = cur.select(*KEYS, F.col("md5").alias("h_cur"), F.lit(True).alias("in_cur"))
    j = r.join(c, KEYS, "full_outer")
    status = (
        F.when(F.col("in_ref").isNull(), "added")
        .when(F.col("in_cur").isNull(), "removed")
        .when(~F.col("h_ref").eqNullSafe(F.col("h_cur")), "modified")
        .otherwise("same")
    )
    out = j.select(*KEYS, status.alias("status"))
    return out if include_same else out.where(F.col("status") != "same")


def compare_snapshots(ref: DataFrame, cur: DataFrame, include_same: bool = False) -> DataFrame:
    """Content comparison of two ``files`` snapshots."""
    r = _digest(ref).withColumnsRenamed({"h": "h_ref", "n": "n_ref"}).withColumn("in_ref", F.lit(True))
    c = _digest(cur).withColumnsRenamed({"h": "h_cur", "n": "n_cur"}).withColumn("in_cur", F.lit(True))
    j = r.join(c, KEYS, "full_outer")
    same = F.col("h_ref").eqNullSafe(F.col("h_cur")) & F.col("n_ref").eqNullSafe(F.col("n_cur"))
    status = (
        F.when(F.col("in_ref").isNull(), "added")
        .when(F.col("in_cur").isNull(), "removed")
        .when(~same, "modified")
        .otherwise("same")
    )
    out = j.select(*KEYS, status.alias("status"))
    return out if include_same else out.where(F.col("status") != "same")


def change_summary(changes: DataFrame) -> DataFrame:
    """A5: +added / ~modified / -removed per project (partial aggregation map-side)."""
    return changes.groupBy("project").agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "modified").alias("modified"),
        F.count_if(F.col("status") == "removed").alias("removed"),
    ).withColumn(
        "summary",
        F.format_string("+%d | ~%d | -%d", F.col("added"), F.col("modified"), F.col("removed")),
    )


def set_changes(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """O1: added = cur - ref, removed = ref - cur, common = cur ∩ ref (on keys)."""
    r = ref.select(*KEYS).distinct().withColumn("in_ref", F.lit(True))
    c = cur.select(*KEYS).distinct().withColumn("in_cur", F.lit(True))
    name = F.when(F.col("in_ref").isNull(), "added").when(F.col("in_cur").isNull(), "removed").otherwise("common")
    return r.join(c, KEYS, "full_outer").select(*KEYS, name.alias("set_name"))


def needs_update(store: DataFrame, updates: DataFrame) -> DataFrame:
    """True when the path is new or its md5 differs from the stored one."""
    s = store.select(*KEYS, F.col("file_hash"))
    u = updates.select(*KEYS, F.md5("content").alias("h"))
    j = u.join(s, KEYS, "left")
    return j.select(*KEYS, (~F.col("h").eqNullSafe(F.col("file_hash"))).alias("needs_update"))


def orphans(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored paths missing from the incoming set. A project with no incoming
    rows at all deletes nothing (the reference returns early on an empty list)."""
    present = incoming.select("project").distinct()
    s = store.select(*KEYS).join(small(present), "project", "left_semi")
    return s.join(incoming.select(*KEYS), KEYS, "left_anti")


def file_diffs(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """(project, path, diff) of the files that changed; empty content counts as missing.

    Keys and md5 decide what changed; only changed files' texts are fetched and joined.
    New and deleted files get a fixed note from Spark; Python compares the others' lines.
    """
    changed = compare_snapshots(_filled(ref), _filled(cur)).select(*KEYS)
    r = _filled(ref).join(changed, KEYS, "left_semi").select(*KEYS, F.col("content").alias("old"))
    c = _filled(cur).join(changed, KEYS, "left_semi").select(*KEYS, F.col("content").alias("new"))
    j = r.join(c, KEYS, "full_outer")
    note = (
        F.when(F.col("old").isNull(), F.concat(F.lit("(New File: "), "path", F.lit(")")))
        .when(F.col("new").isNull(), F.concat(F.lit("(Deleted File: "), "path", F.lit(")")))
    )
    j = j.withColumn("diff", note)

    def run(batches):
        for pdf in batches:
            both = pdf["diff"].isna()
            pdf.loc[both, "diff"] = ["\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), f"SNAPSHOT/{p}", f"CURRENT/{p}", lineterm=""))
                                     for p, a, b in pdf.loc[both, ["path", "old", "new"]].itertuples(index=False)]
            yield pdf[["project", "path", "diff"]]

    return j.mapInPandas(run, "project string, path string, diff string")


def _filled(files: DataFrame) -> DataFrame:
    return files.select(*KEYS, "content").where(F.length("content") > 0)


def diff_line_classes(diffs: DataFrame) -> DataFrame:
    """One row per diff line with its class."""
    x = diffs.select(*KEYS, F.posexplode(F.split("diff", "\n")).alias("line_no", "line"))
    cls = (
        F.when(F.col("line").startswith("+++") | F.col("line").startswith("---"), "header")
        .when(F.col("line").startswith("@@"), "hunk")
        .when(F.col("line").startswith("+"), "added")
        .when(F.col("line").startswith("-"), "removed")
        .otherwise("context")
    )
    return x.select(*KEYS, F.col("line_no").cast("long").alias("line_no"), "line", cls.alias("kind"))
