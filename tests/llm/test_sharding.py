"""Shards against the plain algorithm: all groups by size through one heap."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import queries, sharding


def plain_loads(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    for s in sorted(sizes, reverse=True):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + s, k))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


def test_schedule_by_classes_gives_the_loads_of_all_groups():
    rng = np.random.default_rng(3)
    for shards in (1, 2, 5, 40):
        for _ in range(60):
            sizes = (16 + rng.zipf(1.5, int(rng.integers(0, 3000))).clip(max=int(rng.integers(1, 5000)))).tolist()
            if rng.random() < 0.4:
                sizes.append(int(sum(sizes) // 2) + 16)
            classes = sorted(Counter(sizes).items(), reverse=True)
            plan, loads = sharding.schedule(classes, shards)
            assert loads == plain_loads(sizes, shards)
            again = [0] * shards
            for (size, count), (_, _, ends, picked) in zip(classes, plan):
                assert ends[-1] == count
                for k, n in zip(picked, np.diff([0, *ends])):
                    again[k] += size * int(n)
            assert again == loads


def check(got, rows, shards=40):
    text = defaultdict(list)
    for d, t in rows:
        text[d].append(t or "")
    shard_of, slots, loads = {}, defaultdict(list), [0] * shards
    left = {d: Counter((len(t.encode()) + 16, zlib.crc32(t.encode())) for t in ts) for d, ts in text.items()}
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None)
        left[r.doc_id][(r["size"], r.text_crc32)] -= 1
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
        shard_of.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(v == 0 for c in left.values() for v in c.values())
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    assert loads == plain_loads(groups.values(), shards)
    for t in groups:  # a group stays together (crc32 has no collisions here)
        assert len(shard_of[(len(t.encode()) + 16, zlib.crc32(t.encode()))]) == 1


def test_query_against_plain(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, f"{k} " + "x" * min(3000, int(rng.zipf(1.6)))) for k in range(1500)]
    rows += [(2000 + k, "the hot text") for k in range(900)] + [(4000 + k, f"group {k % 20}") for k in range(300)]
    rows += [(None, "no id"), (None, None), (7, None), (8, ""), (7, "again"), (7, "again"), (9000, "ä" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("rank", F.lit(1))
    df.repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = got.collect()
    check(got, rows)
    assert {tuple(r) for r in got} == {tuple(r) for r in queries.op11_sharding(spark, str(tmp_path)).collect()}


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sharding, "small", lambda df: df)
    rows = [(k, f"t{k % 70}" * (k % 5)) for k in range(400)]
    check(sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_few_rows_and_empty_table(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = sharding.assign(spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.slot) for r in got) == [("a", 0), ("b", 0)] and len({r.shard for r in got}) == 2


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 50}", "s") for k in range(300)], "doc_id long, text string, source string")
    sharding.write(docs, str(tmp_path / "out"), shards=4, file_bytes=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
