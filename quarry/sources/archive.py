"""Restorable archives and marked-text recovery.

An archive row holds one shard of one project: a JSON map path -> raw content,
zlib-compressed, base64 encoded, with a sha256 over the base64 text. Shards are
assigned by hashing the path into ``ceil(project_bytes / shard_bytes)`` buckets,
so no project-wide sort or single-task group is needed and every shard stays
near the target size. Only zlib runs in Python (stdlib, inside the tasks).
"""

from __future__ import annotations

import string
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.bounded import small
from quarry.operators.secrets import scrub
from quarry.session import stored

# Markers of the archive block (configurable; the reader accepts any marker pair).
BLOCK_START = "--- RESTORE_BLOCK_START ---"
BLOCK_END = "--- RESTORE_BLOCK_END ---"
FILE_START_RX = r"(?s)--- START_FILE:\s*(.+?)\s*---\s*\n(.*?)\n--- END_FILE ---"
FORCE_FILE_RX = r"(?s)--- START_FILE: (.*?) ---\n(.*?)--- END_FILE ---"
TREE_SECTION_RX = r"(?s)CONTEXT: PROJECT STRUCTURE\s*\n.*?Below is the file tree.*?\n\n(.*?)(?=\n\n---|\z)"
SHARD_BYTES = 64 * 1024 * 1024
MAX_SCRAPED_NAME = 200
#: A character that base64 has not. Each one it has is named: Java looks these up in a table of bits, while ranges
#: cost a chain of calls for every character.
NOT_BASE64_RX = f"[^{string.ascii_letters}{string.digits}+/=]"
#: A task of the compressor gives its rows on when they hold this much.
GIVE_BYTES = 4 * 1024 * 1024


def _between(text: F.Column, start: str, end: str) -> F.Column:
    """What stands between the first start marker and the end marker next to it, without white space around
    it; null if there are no such two."""
    at = F.instr(text, F.lit(start))
    rest = F.when(at > 0, F.substr(text, at + len(start)))
    to = F.instr(rest, F.lit(end))
    return F.when(to > 0, F.btrim(F.substr(rest, F.lit(1), to - 1), F.lit(" \t\n\x0b\f\r")))


def _coded(value: pa.Scalar, compress: bool) -> bytes | None:
    if not value.is_valid:
        return None
    try:
        return zlib.compress(value.as_buffer()) if compress else zlib.decompress(value.as_buffer())
    except zlib.error:
        return None


def _zlib(col: str, out: str, compress: bool, give_bytes: int = GIVE_BYTES):
    """A task function: column ``col`` as ``out`` behind the others. Values are read in place one by one and given on
    as soon as ``give_bytes`` are there, so a task holds what it was handed and little besides."""

    def run(batches):
        for b in batches:
            rest = [n for n in b.schema.names if n != col]
            done, vals, size = 0, [], 0
            for i in range(b.num_rows):
                vals.append(_coded(b.column(col)[i], compress))
                size += len(vals[-1] or b"")
                if size >= give_bytes or i == b.num_rows - 1:
                    own = [b.column(n).slice(done, len(vals)) for n in rest]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(vals, pa.binary())], names=[*rest, out])
                    done, vals, size = i + 1, [], 0
            del b  # not kept while the next one is read

    return run


def pack(files: DataFrame, shard_bytes: int = SHARD_BYTES, start: str = BLOCK_START, end: str = BLOCK_END,
         redact: bool = True) -> DataFrame:
    """archives(project, shard, checksum, payload, block). A path listed twice
    keeps its last (highest ``ord``) content. Secret values are replaced (R2) unless an
    exact copy is asked for with ``redact=False``. Sizes come from lengths only, so content
    is shuffled by (project, path) and by shard, never by project."""
    if redact:
        files = stored(scrub(files), "scrubbed")
    sized = files.groupBy("project", "path").agg(F.max_by(F.octet_length("content"), "ord").alias("bytes"))
    sizes = sized.groupBy("project").agg(F.sum("bytes").alias("bytes"))
    n = F.greatest(F.ceil(F.col("bytes") / F.lit(shard_bytes)), F.lit(1)).cast("int")
    last = files.groupBy("project", "path").agg(F.max_by("content", "ord").alias("content"))
    sharded = last.join(small(sizes.select("project", n.alias("n"))), "project").withColumn(
        "shard", F.pmod(F.xxhash64("path"), F.col("n")).cast("int"))
    maps = sharded.groupBy("project", "shard").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "content")))).alias("json"))
    raw = maps.select("project", "shard", F.encode("json", "UTF-8").alias("data"))
    comp = raw.mapInArrow(_zlib("data", "z", True), "project string, shard int, z binary")
    # base64 may be emitted in 76-character lines; the payload is one line.
    b64 = comp.select("project", "shard", F.regexp_replace(F.base64("z"), r"\s+", "").alias("payload"))
    out = b64.withColumn("checksum", F.sha2("payload", 256))
    return out.withColumn("block", F.concat(F.lit(start + "\n"), F.lit("sha256:"), "checksum", F.lit("\n"), "payload",
                                            F.lit("\n" + end)))


def unpack(archives: DataFrame, text_col: str = "block", policy: str = "strict", start: str = BLOCK_START,
           end: str = BLOCK_END, keys=("project", "shard")) -> DataFrame:
    """S6 + S7: find the block, verify the checksum after removing all whitespace,
    base64 -> zlib -> JSON -> rows. Status per archive: ok, mismatch, legacy (no
    checksum line), missing (no block), corrupt (decode failed). ``strict`` drops
    everything but ok/legacy rows; ``lenient`` also decodes mismatches."""
    has, with_sum = F.col("_raw").isNotNull(), F.col("_raw").startswith("sha256:")
    rest = F.when(F.instr(F.col("_raw"), "\n") > 0, F.expr("substr(_raw, instr(_raw, '\n') + 1)"))
    a = archives.select(*keys, _between(F.col(text_col), start, end).alias("_raw"))
    a = a.select(*keys, "_raw", has.alias("_has"), with_sum.alias("_sum"))
    expected = F.trim(F.regexp_replace(F.substring_index(F.col("_raw"), "\n", 1), "^sha256:", ""))
    payload = F.regexp_replace(F.when(F.col("_sum"), rest).otherwise(F.col("_raw")), r"\s+", "")
    a = a.select(*keys, "_has", "_sum", expected.alias("expected"), payload.alias("payload"))
    status = (
        F.when(~F.col("_has"), "missing")
        .when(~F.col("_sum"), "legacy")
        .when(F.col("payload").isNull() | (F.sha2("payload", 256) != F.col("expected")), "mismatch")
        .otherwise("ok")
    )
    a = a.withColumn("status", status)
    decodable = ["ok", "legacy"] + (["mismatch"] if policy == "lenient" else [])
    # characters beside the alphabet are passed over; a payload of the wrong length is corrupt, not an error
    z = F.try_to_binary(F.regexp_replace("payload", NOT_BASE64_RX, ""), F.lit("base64"))
    opened = F.col("status").isin(*decodable)
    # one pass over all archives: those that are not opened have a null payload
    dec = a.select(*keys, "status", F.when(opened, z).alias("z"))
    schema = ", ".join(f"{k} {'int' if k == 'shard' else 'string'}" for k in keys)
    js = dec.mapInArrow(_zlib("z", "data", False), f"{schema}, status string, data binary")
    m = js.select(*keys, "status", F.from_json(F.decode("data", "UTF-8"), "map<string,string>").alias("m"))
    return m.select(*keys, F.when(opened & F.col("m").isNull(), "corrupt").otherwise(F.col("status")).alias("status"),
                    F.explode_outer("m").alias("path", "content"))


def scrape_marked(docs: DataFrame, text_col: str = "text", key: str = "project", piece: str | None = None) -> DataFrame:
    """(path, content) from START_FILE/END_FILE text; content right-trimmed;
    a repeated path keeps its last block. ``piece`` orders the rows of a document in several."""
    part = F.col(piece).alias("piece") if piece else F.lit(0).alias("piece")
    z = docs.select(key, part, F.posexplode(F.arrays_zip(
        F.regexp_extract_all(text_col, F.lit(FILE_START_RX), 1).alias("p"),
        F.regexp_extract_all(text_col, F.lit(FILE_START_RX), 2).alias("c"))).alias("pos", "b"))
    z = z.select(key, "piece", "pos", F.regexp_extract("b.p", r"(?s)^\s*(.*?)\s*$", 1).alias("path"),
                 F.regexp_replace("b.c", r"\s+$", "").alias("content"))
    return z.groupBy(key, "path").agg(F.max_by("content", F.struct("piece", "pos")).alias("content"))


def force_scrape(docs: DataFrame, text_col: str = "text", key: str = "project") -> DataFrame:
    """Lossy recovery: drop every backslash, then blocks; content stripped; last wins.
    ``plausible`` is false for names over 200 characters or with a newline, which the
    recovery of a damaged text should not write."""
    clean = F.replace(F.col(text_col), F.lit("\\"), F.lit(""))
    z = docs.select(key, F.posexplode(F.arrays_zip(
        F.regexp_extract_all(clean, F.lit(FORCE_FILE_RX), 1).alias("p"),
        F.regexp_extract_all(clean, F.lit(FORCE_FILE_RX), 2).alias("c"))).alias("pos", "b"))
    z = z.select(key, "pos", F.regexp_extract("b.p", r"(?s)^\s*(.*?)\s*$", 1).alias("path"),
                 F.regexp_extract("b.c", r"(?s)^\s*(.*?)\s*$", 1).alias("content"))
    fine = (F.length("path") <= MAX_SCRAPED_NAME) & ~F.col("path").contains("\n")
    return z.groupBy(key, "path").agg(F.max_by("content", "pos").alias("content")).withColumn("plausible", fine)


def tree_section(docs: DataFrame, text_col: str = "text", key: str = "project") -> DataFrame:
    """The tree text between the structure header and the first '\\n\\n---'."""
    return docs.select(key, F.regexp_replace(F.regexp_extract(text_col, TREE_SECTION_RX, 1), r"^\s+|\s+$", "").alias("tree"))


def load_snapshot(docs: DataFrame, text_col: str = "text", key: str = "project", piece: str | None = None) -> DataFrame:
    """(key, path, content, source, status) of documents given as one or more rows each: archive
    shards, marked text, or both. ``piece`` orders a document's rows.

    A document is restored from its archive blocks if each of them decodes and they hold a file; a
    checksum that differs is no obstacle, but its document's status is 'mismatch' instead of 'ok'. Otherwise the
    marked text of all its rows is scraped. One without text has a row with status 'no_text', one that
    yields no file 'no_files'."""
    part = F.col(piece) if piece else F.lit(0)
    arch = unpack(docs.select(key, part.cast("int").alias("shard"), text_col), text_col, policy="lenient", keys=(key, "shard"))
    arch = stored(arch.where(F.col("status") != "missing"), "unpacked")
    state = arch.groupBy(key).agg(
        (F.max(F.col("path").isNotNull()) & ~F.max(F.col("status") == "corrupt")).alias("whole"),
        F.when(F.max(F.col("status") == "mismatch"), "mismatch").otherwise("ok").alias("status"))
    state = state.where("whole").select(key, "status")
    good = arch.where(F.col("path").isNotNull()).select(key, "path", "content").join(state, key)
    scraped = scrape_marked(docs.join(state.select(key), key, "left_anti"), text_col, key, piece).withColumn("status", F.lit("ok"))
    files = good.withColumn("source", F.lit("archive")).unionByName(scraped.withColumn("source", F.lit("scrape")))
    none = F.lit(None).cast("string")
    blank = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", "")) == 0
    bad = docs.groupBy(key).agg(F.when(F.min(blank), "no_text").otherwise("no_files").alias("status")).join(files.select(key).distinct(), key, "left_anti")
    bad = bad.select(key, none.alias("path"), none.alias("content"), none.alias("source"), "status")
    return files.select(key, "path", "content", "source", "status").unionByName(bad)


def snapshot_totals(loaded: DataFrame, key: str = "project") -> DataFrame:
    """S10 totals per document: files, characters, tokens (characters // 4 of the sum), status."""
    s = loaded.groupBy(key, "status").agg(F.count("path").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("chars"))
    return s.withColumn("tokens", F.expr("chars DIV 4"))
