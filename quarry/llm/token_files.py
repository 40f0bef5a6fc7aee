"""Token ids in Arrow stream files of equal-length sequences.

Documents are dealt out by ranges of doc_id. A task encodes its range with the tokenizers library, ends each
document with ``END_ID``, and writes one Arrow IPC file: record batches of fixed-size lists ``ids`` (unsigned 16 or
32 bits, by the vocabulary) and ``mask`` (false where the last sequence is padded), so that any sequence can be
read in place from a memory map; ``docs`` lists the documents that begin in a sequence. Files in order of their
names hold all documents in ascending doc_id (null first, rows that repeat an id in order of their text).

The texts of a batch are one byte buffer, cut where the tokenizer's own pattern always cuts (white space, and between
letters, digits and signs), at once for all bytes. Equal parts of a batch are looked up once in a bounded memo of the
worker, and only new parts go to the library: plain words of a byte-level vocabulary straight to its
model, since the pattern takes such a word whole, all others through the whole tokenizer. Texts that hold one of the tokenizer's added tokens
are cut at it first, and it gets its own id as in the library's plain ``encode(text, add_special_tokens=False)``.
Null texts are empty: only the end id. A vocabulary that joins a line feed to its neighbours ends in ValueError.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import shared_files
from quarry.llm.common import blocks, in_arrow, store, utf8

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 256
MEMO_PARTS = 600_000
#: New parts encoded in one call.
JOIN_PARTS = 512
#: The white space of the tokenizer's pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Letters whose runs the pattern never joins to the ASCII signs and digits that may follow.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The UTF-8 bytes of that white space beyond ASCII.
WIDE_SPACES = [c.encode() for c in SPACES if ord(c) > 127]
_PARTS = re.compile(rf" ?[{LETTERS}]+(?=[!-@\[-`{{-~{SPACES}]|\Z)| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
_WORD = re.compile(rf" ?[{LETTERS}]+").fullmatch


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {b: b for b in seen} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


_LETTER = byte_letters()

#: Classes of bytes; bytes of characters beyond ASCII are not told apart but for the letters of Latin-1.
OTHER, SPACE, LETTER, DIGIT, SIGN = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[:128] = SIGN
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = LETTER
_CLASS[[b for b in range(128) if chr(b).isdigit()]] = DIGIT
_CLASS[[ord(c) for c in SPACES if ord(c) < 128]] = SPACE
#: Class pairs between which the pattern always cuts; a quote before a letter is left out where it is looked up.
_APART = np.zeros((5, 5), bool)
for _a, _b in ((LETTER, DIGIT), (LETTER, SIGN), (DIGIT, SIGN)):
    _APART[_a, _b] = _APART[_b, _a] = True
_APART[[OTHER, LETTER, DIGIT, SIGN], SPACE] = True


def certain_cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places at which parts of the texts begin, text starts among them. White space beyond ASCII is not known here."""
    kind = _CLASS[buf]
    two = np.flatnonzero(buf[:-1] == 0xC3)  # the letters of Latin-1 but for the signs of multiplication and division
    two = two[(buf[two + 1] != 0x97) & (buf[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = LETTER
    new = np.zeros(len(buf) + 1, bool)
    new[off] = True
    quote = (buf[:-1] == ord("'")) & (kind[1:] == LETTER)
    new[1:-1] |= _APART[kind[:-1], kind[1:]] & ~quote
    blank = kind == SPACE
    ends_text = np.zeros(len(buf) + 1, bool)
    ends_text[off] = True
    last = np.flatnonzero(blank[:-1] & ~blank[1:])  # white space before something else, in the same text
    last = last[~ends_text[last + 1]]
    new[last[(last > 0) & blank[last - 1]]] = True  # joins what follows, not the white space before it
    new[last[buf[last] != 0x20] + 1] = True  # only a blank joins what follows
    return np.flatnonzero(new[:-1])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces_of(col: pa.Array) -> list[bytes]:
    """The values of a column of large binaries without nulls."""
    if len(col) == 0:
        return []
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """Ids of texts by way of a memo of their parts; ``special``: special tokens in a text are found, as the library does by default."""

    def __init__(self, raw: str, special: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw)
        self.tokenizer.encode_special_tokens = not special
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        names = sorted((re.escape(t.content) for t in added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(names)})") if names else None
        self.names = [t.content.encode() for t in added]
        #: Whether a text can be cut at its added tokens: none takes part of the text beside it.
        self.cuts = not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        how = json.loads(raw)
        before = how.get("pre_tokenizer") or {}
        #: Whether a plain word's ids are those of the model alone: bytes as letters, cut by the pattern, nothing else.
        self.bare = how.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
        self.model = self.tokenizer.model
        self.reset()

    def reset(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, self.dtype), 0
        self.off = np.zeros(1 << 18, np.int64)

    def parts(self, text: str) -> list[str]:
        """The parts of a text that encode apart; an added token is a part, or the whole text if it cannot be cut there."""
        if self.added is None or not self.added.search(text):
            return _PARTS(text)
        if not self.cuts:
            return [text]
        return [p for k, piece in enumerate(self.added.split(text)) for p in ([piece] if k % 2 else _PARTS(piece))]

    def alone(self, part: str) -> bool:
        return part[-1] in SPACES or (self.added is not None and self.added.search(part) is not None)

    def learn(self, new: list[bytes]) -> None:
        """Encodes new parts, many to a call: a line feed between them is a token of its own."""
        parts = [p.decode() for p in new]
        if self.bare:
            words = [p for p in parts if _WORD(p)]
            parts = [p for p in parts if not _WORD(p)]
            self.learn_words(words)
        plain = [p for p in parts if not self.alone(p)]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        got = []
        for at in range(0, len(plain), JOIN_PARTS):
            got.append(np.array(self.tokenizer.encode("\n".join(plain[at : at + JOIN_PARTS]), add_special_tokens=False).ids + feed, self.dtype))
        ids = np.concatenate([np.zeros(0, self.dtype), *got])
        ends = np.flatnonzero(ids == feed[0])
        if len(feed) != 1 or len(ends) != len(plain):
            raise ValueError("the vocabulary does not keep a line feed apart")
        self.add(plain, ids[ids != feed[0]], ends - np.arange(len(plain)))
        for p in parts:  # white space, added tokens
            if self.alone(p):
                own = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, self.dtype)
                self.add([p], own, np.array([len(own)]))

    def learn_words(self, words: list[str]) -> None:
        """Encodes plain words by the tokenizer's model alone."""
        if not words:
            return
        tokenize = self.model.tokenize
        spelled = "\n".join(words).encode().decode("latin-1").translate(_LETTER).split(chr(_LETTER[10]))
        got = [[t.id for t in tokenize(w)] for w in spelled]
        self.add(words, np.fromiter(chain.from_iterable(got), self.dtype), np.cumsum(np.fromiter(map(len, got), np.int64, len(got))))

    def add(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.code)
        while len(self.off) <= n + len(parts):
            self.off = np.concatenate((self.off, np.zeros_like(self.off)))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), self.dtype)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[n + 1 : n + 1 + len(parts)] = self.used + ends
        self.used += len(ids)
        self.code.update(zip(map(str.encode, parts), range(n, n + len(parts)), strict=True))

    def cut(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the parts of all texts; texts with an added token or wide white space are cut by the pattern."""
        starts = certain_cuts(buf, off)
        raw = buf.tobytes()
        odd = [np.flatnonzero(buf[:-1] == w[0]) for w in {w[0]: w for w in WIDE_SPACES}.values()]
        at = [a for a in np.concatenate([np.zeros(0, np.int64), *odd]).tolist() if raw.startswith(tuple(WIDE_SPACES), a)]
        if self.added is not None:
            at += [m.start() for name in self.names for m in re.finditer(re.escape(name), raw)]
        if not at:
            return starts
        odd = np.unique(np.searchsorted(off, at, side="right") - 1)
        mine = np.isin(np.searchsorted(off, starts, side="right") - 1, odd)
        more = [starts[~mine]]
        for k in odd.tolist():
            parts = self.parts(raw[off[k] : off[k + 1]].decode())
            more.append(off[k] + np.cumsum([0, *(len(p.encode()) for p in parts[:-1])]))
        return np.sort(np.concatenate(more))

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and n + 1 offsets."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        if len(self.code) > MEMO_PARTS:
            self.reset()
        buf, off = utf8(texts)
        starts = self.cut(buf, off) if len(buf) else np.zeros(0, np.int64)
        ends = np.append(starts, len(buf)).astype(np.int64)
        data = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(buf)]).dictionary_encode()
        kinds = pieces_of(data.dictionary)
        known = self.code.get
        found = list(map(known, kinds))
        if None in found:
            self.learn([p for p, c in zip(kinds, found, strict=True) if c is None])
            found = list(map(known, kinds))
        part = np.array(found, np.int64)[data.indices.to_numpy()]
        first = np.searchsorted(starts, off)  # of each text among the parts
        codes = np.full(len(part) + len(off) - 1, -1, np.int64)
        codes[np.arange(len(part)) + np.repeat(np.arange(len(off) - 1), np.diff(first))] = part
        end = codes < 0
        begin = np.where(end, 0, self.off[codes])
        size = np.where(end, 1, self.off[codes + 1] - begin)
        place = np.cumsum(size) - size
        ids = self.flat[np.repeat(begin - place, size) + np.arange(int(size.sum()))]
        ids[place[end]] = END_ID
        return ids, np.concatenate(([0], (place + size)[end]))


_encoders: dict[int, Encoder] = {}


def _encoder(raw: str) -> Encoder:
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(raw, special=True)
    return _encoders[key]


_DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them as record batches."""

    def __init__(self, out, dtype: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH):
        self.sequence, self.batch, self.dtype = sequence, batch, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence)), ("docs", _DOC)])
        self.writer = pa.ipc.new_file(out, self.schema)
        self.ids: list[np.ndarray] = []
        self.held = self.done = self.total = 0  # ids waiting, sequences written, ids of all documents
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, off: np.ndarray) -> None:
        starts = (off[:-1] + self.total).tolist()
        self.docs += zip(doc_ids, starts, np.diff(off).tolist(), strict=True)
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        full = self.sequence * self.batch
        if self.held >= full:
            flat = np.concatenate(self.ids)
            for at in range(0, len(flat) - full + 1, full):
                self.put(flat[at : at + full], full)
            rest = flat[len(flat) // full * full :]
            self.ids, self.held = [rest], len(rest)

    def put(self, flat: np.ndarray, real: int) -> None:
        n = len(flat) // self.sequence
        until = (self.done + n) * self.sequence
        k = next((i for i, d in enumerate(self.docs) if d[1] >= until), len(self.docs))
        mine, self.docs = self.docs[:k], self.docs[k:]
        row = np.array([d[1] // self.sequence - self.done for d in mine], np.int64)
        off = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        fields = [pa.array([d[i] for d in mine], pa.int64()) for i in range(3)]
        docs = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays(fields, ["doc_id", "start", "n_tokens"]))
        mask = pa.array(np.arange(len(flat)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.sequence), pa.FixedSizeListArray.from_arrays(mask, self.sequence), docs.cast(_DOC)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.done += n

    def close(self) -> None:
        flat = np.concatenate([np.zeros(0, self.dtype), *self.ids])
        if len(flat):
            self.put(np.concatenate((flat, np.zeros(-len(flat) % self.sequence, self.dtype))), len(flat))
        self.writer.close()


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, sequence: int = SEQUENCE) -> int:
    """Writes the files of (doc_id, text) below the folder; the number of ids written."""
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary()) as f:
        raw = spark.sparkContext.broadcast(f.read())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        todo = blocks(batches, "text")
        block = next(todo, None)
        if block is None:
            return
        encoder = _encoder(raw.value)
        name = f"part-{TaskContext.get().partitionId():06d}.arrow"
        with shared_files.written(folder, name) as f:
            w = SequenceWriter(f, encoder.dtype, sequence)
            while block is not None:
                w.add(block.column("doc_id").to_pylist(), *encoder.encode(block.column("text")))
                block = next(todo, None)
            w.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([w.total])], names=["name", "tokens"])

    return in_arrow(rows, run, "name string, tokens long").agg(F.sum("tokens")).first()[0] or 0


def documents_of(reader: pa.ipc.RecordBatchFileReader):
    """(doc_id, start in the file, number of ids, checksum of the ids) of each document of a file, in order."""
    open_docs: list[tuple[int | None, int, int]] = []
    crc = at = 0
    for k in range(reader.num_record_batches):
        b = reader.get_batch(k)
        flat = b.column("ids").values.to_numpy()
        flat = flat[: int(np.count_nonzero(b.column("mask").values.to_numpy(zero_copy_only=False)))]
        lists = b.column("docs").flatten()
        open_docs += zip(*(lists.field(i).to_pylist() for i in range(3)), strict=True)
        end, wide = at + len(flat), flat.astype("<u4")
        done = 0
        for doc_id, start, n in open_docs:
            if start >= end:
                break
            crc = zlib.crc32(wide[max(start, at) - at : start + n - at], crc if start < at else 0)
            if start + n > end:
                break
            yield doc_id, start, n, crc
            done += 1
        open_docs, at = open_docs[done:], end


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before."""

    def run(batches):
        for path in shared_files.paths(batches):
            fs, at = shared_files.open_fs(path)
            name = path.rsplit("/", 1)[-1]
            with fs.open_input_file(at) as f:
                rows = list(documents_of(pa.ipc.open_file(f)))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [], []))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *cols], names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = store(in_arrow(shared_files.files(spark, folder, "*.arrow"), run, "file string, doc_id long, start long, n_tokens long, ids_crc32 long"), "tokens")
    per = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    per = per.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(per), F.col("file") == F.col("f")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def sequence_at(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th sequence of a local file and its mask, read in place from a memory map."""
    reader = pa.ipc.open_file(pa.memory_map(path))
    first = reader.get_batch(0)
    b = reader.get_batch(k // first.num_rows) if first.num_rows else first
    row = k % first.num_rows
    size = b.schema.field("ids").type.list_size
    return b.column("ids").values.to_numpy()[row * size : (row + 1) * size], b.column("mask").values[row * size : (row + 1) * size].to_numpy(zero_copy_only=False)
