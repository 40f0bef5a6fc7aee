"""Content store without an ACID table format.

Store state is a table; every change is a join of two tables. Joins that decide what
changes carry keys and md5 only; content is fetched for the rows that need it.

On disk a store is append-only Parquet files of changes, a folder per stream and batch:
each row carries its version, and a tombstone says that a key is gone. The current rows
are the latest change of each key (``latest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.bounded import small

KEYS = ["project", "path"]
STORE_SCHEMA = (
    "project string, path string, file_hash string, content string, file_size int, line_count int, last_updated timestamp"
)
CHANGE_SCHEMA = f"{STORE_SCHEMA}, version long, deleted boolean, stream string"
_STORE_COLUMNS = [f.split()[0] for f in STORE_SCHEMA.split(", ")]
_CHANGE_COLUMNS = [f.split()[0] for f in CHANGE_SCHEMA.split(", ")]
SCHEMA_VERSION = "1"


def as_store_rows(files: DataFrame, now) -> DataFrame:
    """files(project, path, content) -> store rows with md5, sizes and timestamp."""
    ts = F.lit(now).cast("timestamp") if not isinstance(now, F.Column) else now
    return files.select(
        *KEYS, F.md5("content").alias("file_hash"), "content",
        F.length("content").cast("int").alias("file_size"), X.line_count("content").cast("int").alias("line_count"),
        ts.alias("last_updated"),
    )


def sync_actions(store: DataFrame, incoming: DataFrame, delete_missing: bool = True) -> DataFrame:
    """(project, path, action), action in {insert, update, keep, delete}: one full
    outer join of keys and md5. A project absent from ``incoming`` keeps all its rows
    (empty incoming list deletes nothing)."""
    s = store.select(*KEYS, F.col("file_hash").alias("s_hash"), F.lit(True).alias("stored"))
    i = incoming.select(*KEYS, F.md5("content").alias("i_hash"), F.lit(True).alias("given"))
    j = s.join(i, KEYS, "full_outer")
    gone = F.lit("keep")
    if delete_missing:
        present = incoming.select(F.col("project").alias("_p")).distinct().withColumn("_present", F.lit(True))
        j = j.join(small(present), F.col("project") == F.col("_p"), "left")
        gone = F.when(F.col("_present").isNotNull(), "delete").otherwise("keep")
    action = (
        F.when(F.col("stored").isNull(), "insert")
        .when(F.col("given").isNull(), gone)
        .when(~F.col("s_hash").eqNullSafe(F.col("i_hash")), "update")
        .otherwise("keep")
    )
    return j.select(*KEYS, action.alias("action"))


def _new_state(store: DataFrame, incoming: DataFrame, actions: DataFrame, now) -> DataFrame:
    """Stored rows without the replaced and deleted ones, and the rows that come in."""
    changed = actions.where(F.col("action") != "keep")
    fresh = incoming.join(changed.where(F.col("action") != "delete").select(*KEYS), KEYS, "left_semi")
    kept = store.join(changed.select(*KEYS), KEYS, "left_anti")
    return kept.select(*_STORE_COLUMNS).unionByName(as_store_rows(fresh, now))


def upsert(store: DataFrame, updates: DataFrame, now) -> DataFrame:
    """Insert-or-replace by path (no deletes)."""
    return _new_state(store, updates, sync_actions(store, updates, delete_missing=False), now)


def apply_sync(store: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """J3 new state: every action but delete."""
    return _new_state(store, incoming, sync_actions(store, incoming), now)


def action_counts(actions: DataFrame) -> DataFrame:
    """J3 return value: files updated (inserted or changed) per project, plus deletes."""
    return actions.groupBy("project").agg(
        F.count_if(F.col("action").isin("insert", "update")).alias("updated"),
        F.count_if(F.col("action") == "delete").alias("deleted"),
        F.count_if(F.col("action") == "keep").alias("kept"),
    )


def get(store: DataFrame, requests: DataFrame) -> DataFrame:
    """S16 ``store_get`` for a batch of (project, path) requests: null when absent."""
    return requests.join(store.select(*KEYS, "content"), KEYS, "left")


def paths(store: DataFrame) -> DataFrame:
    """S16 ``store_paths``."""
    return store.select(*KEYS)


def all_files(store: DataFrame) -> DataFrame:
    """S16 ``store_all``: non-empty contents only."""
    return store.where(F.length("content") > 0).select(*KEYS, "content")


def delete(store: DataFrame, doomed: DataFrame) -> DataFrame:
    """S17 ``store_delete``."""
    return store.join(doomed.select(*KEYS), KEYS, "left_anti")


def clear(store: DataFrame) -> DataFrame:
    """S17 ``store_clear``: same schema, no rows."""
    return store.limit(0)


def as_changes(files: DataFrame, now, version, stream: str) -> DataFrame:
    """Store rows as changes of one version; ``deleted`` false."""
    rows = as_store_rows(files, now)
    version = version if isinstance(version, F.Column) else F.lit(version)
    return rows.withColumns({"version": version.cast("long"), "deleted": F.lit(False), "stream": F.lit(stream)})


def tombstones(keys: DataFrame, version, stream: str) -> DataFrame:
    """Changes that delete the keys at a version."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in STORE_SCHEMA.split(", ")) if name not in KEYS]
    version = version if isinstance(version, F.Column) else F.lit(version)
    return keys.select(*KEYS, *empty, version.cast("long").alias("version"), F.lit(True).alias("deleted"), F.lit(stream).alias("stream"))


def append_changes(changes: DataFrame, root: str, stream: str, batch: int = 0) -> None:
    """Change files of one batch of one stream. A batch that is written again replaces its own files only."""
    changes.select(*_CHANGE_COLUMNS).write.mode("overwrite").parquet(f"{root.rstrip('/')}/{stream}/{batch:010d}")


def latest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows that the change files below ``root`` leave (as of a version, by default all of them): of each key
    the change of greatest version, deleted keys left out. Which change that is needs keys and versions only."""
    changes = spark.read.schema(CHANGE_SCHEMA).option("recursiveFileLookup", "true").parquet(root)
    if version is not None:
        changes = changes.where(F.col("version") <= version)
    last = changes.groupBy(*KEYS).agg(F.max(F.struct("version", "deleted", "file_hash", "stream")).alias("last")).select(*KEYS, "last.*")
    last = last.where(~F.col("deleted"))
    same = changes["version"].eqNullSafe(last["version"]) & (changes["stream"] == last["stream"]) & ~changes["deleted"]
    return changes.join(last, (changes["project"] == last["project"]) & (changes["path"] == last["path"]) & same, "left_semi").select(*_STORE_COLUMNS)


def clear_changes(spark: SparkSession, root: str, version: int, stream: str = "clear") -> None:
    """S17 on change files: a tombstone for every key there is."""
    append_changes(tombstones(paths(latest(spark, root)), version, stream), root, stream, version)


def save_index(index: DataFrame, path: str) -> None:
    """Vectors and metadata to Parquet (replaces pickle)."""
    index.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
