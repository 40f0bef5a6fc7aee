"""Archives: round trips, segments, chunk framing, revisits."""

import hashlib
import io
import random

import pytest

from quarry.llm import shared_files, warc

SCHEMA = "page_id long, url string, html string"


def through(spark, rows):
    folder = shared_files.new_folder(spark, "warc-test")
    n = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    return n, warc.resolved(warc.read(spark, folder)).collect() if n else []


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and b in first and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return out


def test_round_trip(spark):
    rng = random.Random(2)
    body = lambda n: "".join(rng.choice("abc\r\n é<>0\x00") for _ in range(n))
    long = body(200_000)
    rows = [(i, f"http://h/{i}\r\nx é", body(rng.randint(0, 3000))) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", ""), (60, "u", long), (61, "u", long), (59, "u", long + "x"), (None, "u", long), (70, "u", "a" * 99), (71, "u", "a" * 99), (72, "u", "a" * 100), (73, "u", "a" * 100), (73, "u", "a" * 100), (72, "u", "a" * 100)]
    n, got = through(spark, rows)
    key = lambda r: tuple(map(str, r))
    assert n == len(rows) and all(r.ok for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected(rows), key=key)


def test_repeated_long_pages(spark):
    """Each copy of a page whose block is cut into segments is a row, with its own url and record id."""
    long, other = "a é" * 70_000, "b" * 200_000
    rows = [(5, "http://h/1", long), (5, "http://h/2", long), (5, "http://h/2", long), (5, "http://h/1", other), (9, "http://h/9", long), (9, "http://h/8", long), (None, "http://h/n", long), (None, "http://h/n", long)]
    folder = shared_files.new_folder(spark, "warc-test")
    assert warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), folder) == len(rows)
    records = warc.read(spark, folder)
    assert len({r.record_id for r in records.collect()}) == len(rows)
    got = warc.resolved(records).collect()
    key = lambda r: tuple(map(str, r))
    assert all(r.ok for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(expected(rows), key=key)
    assert sorted((str(r.page_id), r.url) for r in got) == sorted((str(i), u) for i, u, _ in rows)


def test_empty(spark):
    assert through(spark, []) == (0, [])


def test_chunks():
    for n in (0, 1, 7, 8, 9, 100):
        data = bytes(range(n))
        assert warc.unchunked(warc.chunked(data, 8)) == data
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_segments():
    parts = [warc.parsed(next(warc.members(io.BytesIO(r)))) for r in warc.page_records(1, "u", bytes(90_000), "d", None, "0")]
    rows = [{"segment": int(h["warc-segment-number"]), "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "block": b} for h, b in parts]
    assert len(rows) == 3 and parts[1][0]["warc-type"] == "continuation"
    block, ok = warc.reassembled(rows[::-1])
    assert ok and warc.payload_of(block) == bytes(90_000)
    assert not warc.reassembled(rows[:2])[1] and not warc.reassembled(rows[1:])[1]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(warc.record([("WARC-Type", "response")], b"x" * 500)[:-20])))
