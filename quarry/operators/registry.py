"""Project registry and file-list maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.bounded import small

#: Rows of a project whose neighbours are found in one window.
MOVE_BUCKET = 65536


def recent(opens: DataFrame, limit: int | None = None, key: str = "user_id", item: str = "path", ts: str = "ts") -> DataFrame:
    """Upsert + move-to-front: latest open per item, ranked per key, the newest
    ``limit`` if given. The per-(key, item) aggregate is partial; the top-``limit`` window is a
    group limit."""
    last = opens.groupBy(key, item).agg(F.max(ts).alias("last_opened"))
    w = Window.partitionBy(key).orderBy(F.desc("last_opened"), F.asc(item))
    ranked = last.withColumn("rank", F.row_number().over(w))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def latest_attributes(changes: DataFrame, key=("user_id",), attr: str = "event_type", value: str = "value",
                      ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    """Last write wins per (key, attribute)."""
    return changes.groupBy(*key, attr).agg(F.max_by(value, F.struct(ts, tiebreak)).alias("value"),
                                           F.max(ts).alias("updated_at"))


def neighbours(items: DataFrame, scope: str = "project", order: str = "ord", bucket: int = MOVE_BUCKET) -> DataFrame:
    """(scope, path, order, prev, next): each item with the structs (order, path) beside it.

    Windows run over buckets of the order column, then over one row per bucket for the
    items at the buckets' ends, so no window holds a whole project.
    """
    me = F.struct(F.col(order).alias("o"), F.col("path").alias("p"))
    rows = items.select(scope, "path", order, F.floor(F.col(order) / bucket).alias("_b"), me.alias("_me"))
    ends = rows.groupBy(scope, "_b").agg(F.min("_me").alias("_low"), F.max("_me").alias("_high"))
    over = Window.partitionBy(scope).orderBy("_b")
    ends = ends.select(scope, "_b", F.lag("_high").over(over).alias("_before"), F.lead("_low").over(over).alias("_after"))
    w = Window.partitionBy(scope, "_b").orderBy("_me")
    rows = rows.withColumns({"prev": F.lag("_me").over(w), "next": F.lead("_me").over(w)}).join(ends, [scope, "_b"])
    return rows.select(scope, "path", order, F.coalesce("prev", "_before").alias("prev"), F.coalesce("next", "_after").alias("next"))


def move_item(items: DataFrame, requests: DataFrame, scope: str = "project", order: str = "ord") -> DataFrame:
    """Swap a requested item with its neighbour (``direction`` up/down) in the explicit
    order column. Of requests that touch the same item only the one whose item comes first
    in the order is carried out (up before down), so every place is used once."""
    req = requests.select(scope, "path", "direction").distinct()
    asked = neighbours(items, scope, order).join(small(req), [scope, "path"])
    other = F.when(F.col("direction") == "up", F.col("prev")).otherwise(F.col("next"))
    swap = asked.withColumn("other", other).where(F.col("other").isNotNull()).select(
        scope, F.col("path").alias("a"), F.col(order).alias("a_ord"), F.col("other.p").alias("b"), F.col("other.o").alias("b_ord"),
        F.struct(F.col(order).alias("o"), (F.col("direction") == "down").alias("d")).alias("turn"))
    touched = swap.select(scope, F.explode(F.array("a", "b")).alias("x"), "turn").groupBy(scope, "x").agg(F.min("turn").alias("first"))
    t = touched.select(scope, "x", "first")
    won = swap.join(t.withColumnsRenamed({"x": "a", "first": "fa"}), [scope, "a"]).join(t.withColumnsRenamed({"x": "b", "first": "fb"}), [scope, "b"])
    won = won.where((F.col("turn") == F.col("fa")) & (F.col("turn") == F.col("fb")))
    places = won.select(scope, F.col("a").alias("path"), F.col("b_ord").alias("new_ord")).unionByName(won.select(scope, F.col("b").alias("path"), F.col("a_ord").alias("new_ord")))
    out = items.join(small(places), [scope, "path"], "left")
    return out.withColumn(order, F.coalesce("new_ord", F.col(order))).drop("new_ord")


def add_unique(existing: DataFrame, incoming: DataFrame, root_prefix: str, case_insensitive: bool = False,
               scope: str = "project", order: str = "ord") -> DataFrame:
    """Canonical path (relative when inside the project root, else absolute),
    first occurrence kept, already present paths dropped."""
    root = F.concat(F.lit(root_prefix), F.col(scope), F.lit("/"))
    n = P.normalize_path("path")
    canon = F.when(n.startswith(root), F.expr("substring(_n, length(_root) + 1)")).otherwise(n)
    inc = incoming.withColumns({"_n": n, "_root": root}).withColumn("path", canon).drop("_n", "_root")
    key = F.lower("path") if case_insensitive else F.col("path")
    inc = inc.withColumn("_k", key)
    first = inc.groupBy(scope, "_k").agg(F.min_by(F.struct("path", order), F.col(order)).alias("f")).select(
        scope, "_k", F.col("f.path").alias("path"), F.col("f." + order).alias(order))
    ex = existing.select(scope, (F.lower("path") if case_insensitive else F.col("path")).alias("_k"))
    return first.join(ex, [scope, "_k"], "left_anti").drop("_k")


def config_dirs(files: DataFrame, marker_suffix: str, scope: str = "project") -> DataFrame:
    """Directories holding a config file (marker), as (project, dir)."""
    return files.where(F.col("path").endswith(marker_suffix)).select(scope, P.parent("path").alias("dir")).distinct()


def discover_projects(listing: DataFrame, registry: DataFrame, marker_suffix: str, max_depth: int = 3,
                      scope: str = "project") -> DataFrame:
    """Config-bearing directories within depth, outside skipped folders, not
    yet registered."""
    d = config_dirs(listing, marker_suffix, scope)
    parts = F.split("dir", "/")
    d = d.where((F.size(parts) < max_depth) & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in P.SKIP_DIRS])))
    return d.join(registry.select(scope, "dir"), [scope, "dir"], "left_anti")


def cleanup_missing(registry: DataFrame, listing: DataFrame, marker_suffix: str, scope: str = "project") -> DataFrame:
    """Registry entries whose config still exists, with the number dropped per project
    as a column. A project that keeps none has one row without a folder."""
    alive = config_dirs(listing, marker_suffix, scope)
    kept = registry.join(alive, [scope, "dir"], "left_semi")
    dropped = registry.join(alive, [scope, "dir"], "left_anti").groupBy(scope).agg(F.count(F.lit(1)).alias("dropped"))
    return kept.join(dropped, scope, "full_outer").withColumn("dropped", F.coalesce("dropped", F.lit(0)).cast("long"))
