"""Continuous sync, tool-result auto-ingest and chunk assembly (T1-T3) on keyed state.

T1 and T2 keep the version and md5 of every (project, path) as state: unchanged files and
late versions are dropped before anything is written, tombstones delete, and what is left
goes to change files of its batch (``store.append_changes``). A batch that is run again
replaces its own files. T3 keeps the pieces of a message as map state in event time.

Timers and map state need Spark's RocksDB state store; queries are started with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import responses as rs
from quarry.sources import store as sto

FILES_SCHEMA = "project string, path string, ord bigint, content string, version bigint, deleted boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside have the state store that keyed state needs; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class NewestChange(StatefulProcessor):
    """Per key: of a batch's rows the newest version, if it is newer than the state and says something else."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version long, file_hash string, deleted boolean")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        old = self.last.get()
        if old is None or old[0] <= initialState["version"]:
            self.last.update((initialState["version"], initialState["file_hash"], False))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, top = None, None
        for row in rows:
            at = (row["version"], row["ord"] is None, row["ord"] or 0)
            if top is None or at >= top:
                newest, top = row, at
        version, gone, digest = newest["version"], bool(newest["deleted"]), newest["file_hash"]
        old = self.last.get()
        if old is not None and version <= old[0]:
            return  # late or seen before
        self.last.update((version, None if gone else digest, gone))
        if (old is None and gone) or (old is not None and bool(old[2]) == gone and (gone or old[1] == digest)):
            return  # nothing to delete, or the same content
        yield Row(**{c: newest[c] for c in ("project", "path", "version", "deleted", "file_hash", "content")})

    def close(self) -> None:
        pass


_NEWEST = "project string, path string, version long, deleted boolean, file_hash string, content string"


def newest_changes(rows: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Rows (``FILES_SCHEMA``) of a stream that change something. ``held``: (project, path, version, file_hash) that
    the store has before the stream's first batch."""
    hashed = rows.select("project", "path", "ord", "content", "version", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.md5("content").alias("file_hash"))
    initial = held.groupBy("project", "path") if held is not None else None
    return hashed.groupBy("project", "path").transformWithState(NewestChange(), _NEWEST, "append", "None", initial)


def _write_changes(root: str, stream: str, now):
    def write(batch: DataFrame, batch_id: int) -> None:
        stamp = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
        rows = batch.withColumn("stream", F.lit(stream)).withColumns({
            "file_size": F.length("content").cast("int"), "line_count": sto.X.line_count("content").cast("int"), "last_updated": stamp})
        sto.append_changes(rows, root, stream, batch_id)

    return write


def _into_store(rows: DataFrame, store_root: str, checkpoint: str, now, available_now: bool, held: DataFrame | None = None):
    stream = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    with state_store(rows.sparkSession):
        w = newest_changes(rows, held).writeStream.option("checkpointLocation", checkpoint).foreachBatch(_write_changes(store_root, stream, now))
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def continuous_sync(spark: SparkSession, source_dir: str, store_root: str, checkpoint: str, available_now: bool = True,
                    schema: str = FILES_SCHEMA, now=None, held: DataFrame | None = None):
    """Changed files from a stream of file versions into the change files of a store.
    A row with ``deleted`` is a tombstone; versions may arrive in any order and more than
    once. The name of the checkpoint folder is the stream's folder in the store."""
    return _into_store(spark.readStream.schema(schema).parquet(source_dir), store_root, checkpoint, now, available_now, held)


def tool_ingest(spark: SparkSession, source_dir: str, store_root: str, checkpoint: str, schema: str = "name string, content string",
                now=None, available_now: bool = True):
    """Ingestable tool results as store rows keyed by ``mcp://name`` in the project
    ``tools``; of results with one name that of the later file counts."""
    stream = spark.readStream.schema(schema).parquet(source_dir).withColumn("_at", F.unix_micros("_metadata.file_modification_time"))
    at = stream.select("name", F.col("_at").alias("version"), "content")
    rows = rs.tool_rows(at, keep=("version",)).where("ingestable").select(
        F.lit("tools").alias("project"), F.col("source_id").alias("path"), F.lit(0).cast("bigint").alias("ord"),
        F.col("text").alias("content"), "version", F.lit(False).alias("deleted"))
    return _into_store(rows, store_root, checkpoint, now, available_now)


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """T3 (batch): chunks concatenated in order per message, emitted only when
    the last chunk is present and no piece is missing; empty results dropped.
    A message is a bounded group (one model response)."""
    g = chunks.groupBy("message_id").agg(
        F.max(F.when(F.col("is_last"), F.col("seq"))).alias("last_seq"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda s: s["chunk"]), "").alias("text"),
    )
    return g.where(F.col("last_seq").isNotNull() & (F.col("n") == F.col("last_seq") + 1) & (F.length("text") > 0)).select(
        "message_id", "text")


class Assembly(StatefulProcessor):
    """Per message: a map entry per piece, and what is known of the whole. A message that is not
    whole ``wait_ms`` after its newest piece leaves a row that says how many pieces came and are missing."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "seq long", "chunk string")
        self.known = handle.getValueState("known", "last long, n long, expires long, done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.known.get()
        last, n, expires, done = before or (-1, 0, 0, False)
        newest, came = 0, {}
        for r in rows:
            newest = max(newest, r["ts_ms"])
            # repeated pieces count once: of those of a batch the earliest, then the greatest text
            at = (-r["ts_ms"], r["chunk"] is not None, r["chunk"] or "")
            if r["seq"] not in came or at > came[r["seq"]]:
                came[r["seq"]] = at
            if r["is_last"]:
                last = max(last, r["seq"])
        fresh = {}
        if not done:
            # pieces are looked up one by one only in a message that began in an earlier batch
            fresh = {seq: at[2] for seq, at in came.items() if not n or not self.pieces.containsKey((seq,))}
            whole = last >= 0 and n + len(fresh) == last + 1
            if whole:
                text = "".join(fresh[k] if k in fresh else self.pieces.getValue((k,))[0] or "" for k in range(last + 1))
                if n:
                    self.pieces.clear()
            else:  # only what has to wait is kept
                for seq in fresh:
                    self.pieces.updateValue((seq,), (fresh[seq],))
            n, done = n + len(fresh), whole
            if whole and text:
                yield Row(message_id=key[0], text=text, received=n, missing=0)
        if newest + self.wait_ms > expires:
            if expires:
                self.handle.deleteTimer(expires)
            expires = newest + self.wait_ms
            self.handle.registerTimer(expires)
        self.known.update((last, n, expires, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, n, _, done = self.known.get()
        if not done:
            self.pieces.clear()
        self.known.clear()
        if not done:
            yield Row(message_id=key[0], text=None, received=n, missing=last + 1 - n if last >= 0 else None)

    def close(self) -> None:
        pass


def assemble_chunks_stream(chunks: DataFrame, delay: str = "10 minutes", wait_ms: int = 600_000) -> DataFrame:
    """T3 (streaming): (message_id, text, received, missing) in event time (column ``ts``).

    A message is given out as soon as its last piece and all before it are there, in whatever
    order they came; pieces that come again or too late change nothing. When the watermark is
    ``wait_ms`` past its newest piece, an incomplete message leaves a row with null text: the
    pieces received and missing (null if the last piece never came). Start it inside
    ``state_store``."""
    timed = chunks.withWatermark("ts", delay)
    timed = timed.select("message_id", "seq", "chunk", F.coalesce("is_last", F.lit(False)).alias("is_last"), "ts", F.unix_millis("ts").alias("ts_ms"))
    return timed.groupBy("message_id").transformWithState(
        Assembly(wait_ms), "message_id long, text string, received long, missing long", "append", "EventTime")
