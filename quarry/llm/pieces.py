"""SentencePiece encoding and decoding as shortest paths of weighted transducers.

Three transducers are compiled from a model file: the normaliser (identity, white space written as U+2581, a
leading one added, extra white space left out if the model says so), the pieces (a trie whose leaves write an id), and
the byte fallback (a code point that no piece has writes its UTF-8 bytes' ids). Composed with an input they give a
lattice; its best path in the tropical semiring is the encoding. A unigram model weighs an arc by minus the piece's
score, a byte fallback by minus the least score plus a penalty, a user-defined piece by its length, as the public
library does. In a BPE model an
arc is free if the piece may follow the one before it, that is, if merging their joined text gives just these
two, and infinite if not; the one path of finite weight is the merge result (a sequence of pieces is what
merging gives if and only if every two neighbours are).

No piece has U+2581 after another code point, so the lattice falls apart before each run of U+2581. The different
parts of a block are composed and searched side by side, a lane each: at a place of all lanes the trie is walked
as arrays and every arc relaxes the weight of the place where it ends. Their ids are kept in a bounded memo per
worker; parts above ``LANE`` code points are searched alone.

Null texts encode to null ids, empty ones to no ids. Decoding gives the text back, save that a U+2581 of the
text itself becomes a space and extra white space that the normaliser leaves out stays out. Rows are encoded one by one: repeated rows and other columns don't matter, and an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import IS_CHAR, blocks, in_arrow, mix, utf8
from quarry.llm.token_files import pieces_of

MODEL = "piece_bpe_32k.model"
MEMO_PARTS = 400_000
MEMO_IDS = 4_000_000
MEMO_PAIRS = 1 << 20
#: Code points of a part that is searched beside others, and parts searched at a time.
LANE = 64
LANES = 1 << 14
SPACE = "▁"
#: Kinds of pieces and of models in the public model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Fixed value: what the public library takes off the least score for a code point without a piece.
PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Numbers:
    """Numbers for keys of 0 or more, looked up and added as arrays (open addressing, at most half full)."""

    def __init__(self, room: int = 1 << 12):
        self.keys, self.values, self.n = np.full(room, -1, np.int64), np.full(room, -1, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; -1: unknown."""
        at = self._slot(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.values[at], -1)
        rest = np.flatnonzero((have != keys) & (have >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.keys) - 1)
            have = self.keys[at]
            hit = have == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (have >= 0)
            rest, at = rest[on], at[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are different and not there yet."""
        room = len(self.keys)
        while 2 * (self.n + len(keys)) > room:
            room *= 2
        if room > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate((self.keys[old], keys)), np.concatenate((self.values[old], values))
            self.keys, self.values, self.n = np.full(room, -1, np.int64), np.full(room, -1, np.int32), 0
        self.n += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for one place the last stays
            put = free & (self.keys[at] == keys)
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.keys) - 1)


class Transducer:
    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(raw)
        n = m.normalizer_spec
        if n.precompiled_charsmap or not n.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped white space is compiled")
        self.squeeze = n.remove_extra_whitespaces
        if m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        self.bpe, self.prefix = m.trainer_spec.model_type == BPE, n.add_dummy_prefix
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER)}
        self.text = [p.piece for p in m.pieces]
        self.weight = [-p.score for p in m.pieces]
        scores = [p.score for p in m.pieces if p.type == NORMAL]
        #: In a unigram model a code point without a piece of its own costs more than any piece.
        self.fallback = PENALTY - min(scores, default=0.0)
        if any(p.type == USER for p in m.pieces):
            if self.bpe:
                raise ValueError("user-defined pieces of a BPE model are not compiled")
            for i, p in enumerate(m.pieces):
                if p.type == USER:  # measured on the public library, whatever the score in the file
                    self.weight[i] = 0.1 - 0.1 * len(p.piece.encode())
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.byte = [bytes_.get(b, unknown) for b in range(256)]
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.encode() for p in m.pieces]
        self.start: dict = {}
        for piece, i in self.id.items():
            node = self.start
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        inner = {c for p in self.id for c in (p[1:] if p.strip(SPACE) else "")}
        if SPACE in inner:
            raise ValueError("a piece has white space inside")
        self.pairs: dict[int, bool] = {}
        self.follows = Numbers()
        #: Line breaks and tabs that no piece has are parts of their own: they always fall back to bytes.
        self.apart = [c for c in "\n\r\t" if c not in inner and c not in self.start]
        self._tables()
        self.reset()

    def _tables(self) -> None:
        """The piece trie as arrays, and the bytes that each id decodes to."""
        letters = sorted({c for p in self.id for c in p})
        self.symbol = np.zeros(0x110000, np.int32)  # 0: no piece has the code point
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.width = len(letters) + 1
        nodes, leaf, keys, to = [(0, self.start)], [-1], [], []
        for state, node in nodes:  # grows on the way
            for c, child in node.items():
                if c:
                    keys.append(state * self.width + int(self.symbol[ord(c)]))
                    to.append(len(nodes))
                    nodes.append((len(nodes), child))
                    leaf.append(child.get("", -1))
        self.leaf = np.array(leaf, np.int32)
        self.first = np.full(self.width, -1, np.int32)
        keys, to = np.array(keys, np.int64), np.array(to, np.int32)
        self.first[keys[keys < self.width]] = to[keys < self.width]
        self.next = Numbers()
        self.next.add(keys, to)
        #: Symbols of code points that are no piece by themselves.
        self.falls = np.append(self.leaf, -1)[self.first] < 0
        self.arc = np.array(self.weight)
        self.byte_id = np.array(self.byte, np.uint32)
        spaced = [r.replace(SPACE.encode(), b" ") for r in self.raw]
        self.raw_bytes = np.frombuffer(b"".join(spaced), np.uint8)
        self.raw_off = np.cumsum([0, *map(len, spaced)])
        self.begins = np.array([i not in self.byte and r[:1] == b" " for i, r in enumerate(spaced)])

    def reset(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.off = np.zeros(1 << 16, np.int64)

    def merge(self, s: str) -> list[str]:
        """The model's merges on a short string: the best-scored neighbours first, the leftmost of equals."""
        part = list(s)
        while True:
            best, at = None, -1
            for i in range(len(part) - 1):
                w = self.id.get(part[i] + part[i + 1])
                if w is not None and (best is None or self.weight[w] < best):
                    best, at = self.weight[w], i
            if best is None:
                return part
            part[at : at + 2] = [part[at] + part[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            ok = self.pairs[key] = self.merge(x + y) == [x, y]
        return ok

    def shortest(self, s: str) -> tuple[int, ...]:
        """Ids on the best path through the lattice of s."""
        n = len(s)
        cost: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # where the last arc begins, and its id (-1: bytes)
        cost[0] = 0.0
        bpe, weight, pairs, may_follow = self.bpe, self.weight, self.pairs, self.may_follow
        for i in range(n):
            here = cost[i]
            if here is None:
                continue
            if bpe and cost[n] is not None:
                break  # the one path of finite weight is there
            before = back[i][1] if i else -1
            key, node, j = before << 20, self.start, i
            while j < n and (node := node.get(s[j])) is not None:
                j += 1
                t = node.get("")
                if t is None:
                    continue
                if bpe:
                    if cost[j] is None:
                        ok = True if before < 0 else pairs.get(key | t)
                        if ok or (ok is None and may_follow(before, t)):
                            cost[j], back[j] = 0.0, (i, t)
                elif cost[j] is None or here + weight[t] < cost[j]:
                    cost[j], back[j] = here + weight[t], (i, t)
            if s[i] not in self.id:
                there = here if self.bpe else here + self.fallback
                if cost[i + 1] is None or (not self.bpe and there < cost[i + 1]):
                    cost[i + 1], back[i + 1] = there, (i, -1)
        if cost[n] is None:
            raise ValueError(f"no path through {s!r}")
        out: list[int] = []
        while n:
            i, t = back[n]
            out += [t] if t >= 0 else [self.byte[b] for b in reversed(s[i:n].encode())]
            n = i
        return tuple(reversed(out))

    def free(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it (negative: bytes or nothing)."""
        keys = before.astype(np.int64) << 20 | piece
        ok = np.ones(len(keys), bool)
        at = np.flatnonzero(before >= 0)
        keys = keys[at]
        known = self.follows.get(keys)
        new = np.unique(keys[known < 0])
        if len(new):
            if self.follows.n + len(new) > MEMO_PAIRS:
                self.follows = Numbers()
                new = np.unique(keys)
            text, merge = self.text, self.merge
            pairs = [(text[k >> 20], text[k & 0xFFFFF]) for k in new.tolist()]
            self.follows.add(new, np.array([merge(x + y) == [x, y] for x, y in pairs], np.int32))
            known = self.follows.get(keys)
        ok[at] = known == 1
        return ok

    def search(self, cps: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids on the best paths of the parts cps[start : start + size], all at once, and how many each part has."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n, longest = len(size), int(size[0])
        place = start[:, None] + np.arange(longest)
        inside = np.arange(longest) < size[:, None]
        point = np.where(inside, cps[np.minimum(place, len(cps) - 1)], 0)
        symbol = np.zeros((n, longest + 1), np.int32)
        symbol[:, :-1] = np.where(inside, self.symbol[point], 0)
        cost = np.full((n, longest + 1), np.inf)
        cost[:, 0] = 0.0
        last = np.full((n, longest + 1), -2, np.int32)  # the id of the arc that ends here; -1: bytes
        back = np.zeros((n, longest + 1), np.int16)  # and where it begins
        for i in range(longest):
            lane = np.flatnonzero((size > i) & np.isfinite(cost[:, i]))
            if self.bpe:  # the one path of finite weight may be there
                lane = lane[np.isinf(cost[lane, size[lane]])]
            falls = lane[self.falls[symbol[lane, i]]]
            there = cost[falls, i] + (0.0 if self.bpe else self.fallback)
            self._relax(cost, last, back, falls, i, i + 1, there, -1)
            state = self.first[symbol[lane, i]]
            j = i + 1
            while True:
                on = state >= 0
                lane, state = lane[on], state[on]
                if not len(lane):
                    break
                piece = self.leaf[state]
                at = np.flatnonzero(piece >= 0)
                to, piece = lane[at], piece[at]
                if self.bpe:
                    better = np.isinf(cost[to, j])
                    to, piece = to[better], piece[better]
                    weight = np.where(self.free(last[to, i], piece), 0.0, np.inf)
                else:
                    weight = self.arc[piece]
                self._relax(cost, last, back, to, i, j, cost[to, i] + weight, piece)
                if j >= longest:
                    break
                state = self.next.get(state.astype(np.int64) * self.width + symbol[lane, j])
                j += 1
        end = size.copy()
        if np.isinf(cost[np.arange(n), end]).any():
            raise ValueError("no path through a part")
        lanes, ids, points = [], [], []
        lane = np.arange(n)
        while len(lane):  # from the ends back
            at = end[lane]
            lanes.append(lane)
            ids.append(last[lane, at])
            end[lane] = back[lane, at]
            points.append(point[lane, end[lane]])
            lane = lane[end[lane] > 0]
        lanes, ids, points = (np.concatenate(x[::-1]) for x in (lanes, ids, points))
        rank = np.argsort(order[lanes], kind="stable")
        lanes, ids, points = order[lanes][rank], ids[rank], points[rank]
        many = np.where(ids >= 0, 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        out = np.repeat(ids, many).astype(np.uint32)
        raw = points[ids < 0].astype("<u4").tobytes().decode("utf-32-le").encode()
        out[np.repeat(ids, many) < 0] = self.byte_id[np.frombuffer(raw, np.uint8)]
        return out, np.bincount(lanes, many, minlength=n).astype(np.int64)

    @staticmethod
    def _relax(cost, last, back, lane, i, j, weight, piece) -> None:
        better = weight < cost[lane, j]
        lane = lane[better]
        cost[lane, j] = weight[better]
        last[lane, j] = piece if np.isscalar(piece) else piece[better]
        back[lane, j] = i

    def learn(self, parts: list[bytes]) -> None:
        """Searches new parts and keeps their ids."""
        chars = [len(p) if p.isascii() else len(p.decode()) for p in parts]
        short = [k for k, c in enumerate(chars) if c <= LANE]
        short.sort(key=chars.__getitem__)
        for at in range(0, len(short), LANES):
            some = short[at : at + LANES]
            cps = np.frombuffer(b"".join([parts[k] for k in some]).decode().encode("utf-32-le"), np.uint32)
            size = np.array([chars[k] for k in some], np.int64)
            self._keep([parts[k] for k in some], *self.search(cps, np.cumsum(size) - size, size))
        for p in (p for p, c in zip(parts, chars, strict=True) if c > LANE):
            ids = self.shortest(p.decode().replace(" ", SPACE))
            self._keep([p], np.array(ids, np.uint32), np.array([len(ids)]))

    def _keep(self, parts: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.code)
        while len(self.off) <= n + len(parts):
            self.off = np.concatenate((self.off, np.zeros_like(self.off)))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.off[n + 1 : n + 1 + len(parts)] = self.used + np.cumsum(size)
        self.used += len(ids)
        self.code.update(zip(parts, range(n, n + len(parts)), strict=True))

    def normalise(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The normaliser's output for all texts; a blank stands for U+2581."""
        if self.squeeze:
            edge = np.zeros(len(buf) + 1, bool)
            edge[off] = True
            blank = buf == 0x20
            first_of = blank & ~(np.append(False, blank[:-1]) & ~edge[:-1])
            lead = np.zeros(len(buf), bool)  # blanks before anything else, or after everything, of their text
            run = np.cumsum(first_of)[blank]
            ends = np.flatnonzero(blank & ~(np.append(blank[1:], False) & ~edge[1:]))
            starts = np.flatnonzero(first_of)
            outer = edge[starts] | edge[ends + 1]
            lead[blank] = outer[run - 1]
            keep = ~lead & (~blank | first_of)
            off = np.concatenate(([0], np.cumsum(keep)))[off]
            buf = buf[keep]
        if self.prefix:
            some = np.diff(off) > 0
            buf = np.insert(buf, off[:-1][some], 0x20)
            off = off + np.concatenate(([0], np.cumsum(some)))
        return buf, off

    def cut(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts of the parts of all normalised texts."""
        at = np.flatnonzero(IS_CHAR[buf])
        cps = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        space = (cps == ord(" ")) | (cps == ord(SPACE))
        new = np.zeros(len(cps) + 1, bool)
        new[:-1] = space
        new[1:-1] &= ~space[:-1]
        for c in self.apart:
            mine = cps == ord(c)
            new[:-1] |= mine
            new[1:] |= mine
        begin = np.zeros(len(buf) + 1, bool)
        begin[at[new[:-1]]] = True
        begin[off] = True
        return np.flatnonzero(begin[:-1])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), and n + 1 offsets."""
        if len(self.code) > MEMO_PARTS or self.used > MEMO_IDS:
            self.reset()
        buf, off = self.normalise(*utf8(texts))
        starts = self.cut(buf, off) if len(buf) else np.zeros(0, np.int64)
        ends = np.append(starts, len(buf)).astype(np.int64)
        data = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        kinds = pieces_of(data.dictionary)
        known = self.code.get
        found = list(map(known, kinds))
        if None in found:
            self.learn([p for p, c in zip(kinds, found, strict=True) if c is None])
            found = list(map(known, kinds))
        part = np.array(found, np.int64)[data.indices.to_numpy()]
        begin = self.off[part]
        size = self.off[part + 1] - begin
        place = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(begin - place[:-1], size) + np.arange(int(place[-1]))]
        return ids, place[np.searchsorted(starts, off)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of the sequences ids[off[k] : off[k + 1]]."""
        begin = self.raw_off[ids]
        size = self.raw_off[ids + 1] - begin
        place = np.concatenate(([0], np.cumsum(size)))
        raw = self.raw_bytes[np.repeat(begin - place[:-1], size) + np.arange(int(place[-1]))].tobytes()
        first = np.zeros(len(off) - 1, np.int64)
        if self.prefix:
            some = np.diff(off) > 0
            first[some] = self.begins[ids[off[:-1][some]]]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip((place[off[:-1]] + first).tolist(), place[off[1:]].tolist(), strict=True)]

    def decode(self, ids) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_compiled: dict[str, Transducer] = {}


def compiled(raw: bytes) -> Transducer:
    """One transducer per model and worker process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(raw)
    return _compiled[key]


def _model(df: DataFrame, path: str | None):
    with open(path or default_model(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32), and ``text`` decoded from the ids in the same pass if asked for.

    The checksum is of the ids as little-endian 32-bit integers.
    """
    model = _model(docs, path)

    def run(batches):
        t = compiled(model.value)
        for b in blocks(batches, "text"):
            texts = b.column("text")
            null = texts.is_null().to_numpy(zero_copy_only=False)
            ids, off = t.encode_all(texts)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(null))
            raw, ends = memoryview(ids.astype("<u4")).cast("B"), (4 * off).tolist()
            crc = pa.array([zlib.crc32(raw[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.int64(), mask=null)
            cols = [b.column("doc_id"), lists, pa.array(np.diff(off), pa.int64()), crc]
            if decoded:
                cols.append(pa.array(t.decode_all(ids.astype(np.int64), off), pa.string(), mask=null))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "ids_crc32", "text"][: len(cols)])

    rows = docs.select("doc_id", "text")
    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, ids_crc32 long" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``encoded`` with ``text``, decoded from ids (null for null)."""
    model = _model(encoded, path)
    names = encoded.columns
    at = names.index("ids")

    def run(batches):
        t = compiled(model.value)
        for b in batches:
            lists = b.column(at)
            text = t.decode_all(lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64))
            null = lists.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string(), mask=null)], names=[*names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return in_arrow(encoded, run, f"{kinds}, text string")
