"""The inverted-file index against exact search, and the block join of probes and corpus."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ivf
from quarry.operators import vectors as vx


def frame(spark, m, name="id"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("piece,block", [(16_384, 1_024), (40, 7)])
def test_index_against_exact_search(spark, tmp_path, monkeypatch, piece, block):
    """Skewed clusters: a third of the vectors in one dense region, whose list is dealt into pieces."""
    monkeypatch.setattr(ivf, "PIECE_ROWS", piece)
    monkeypatch.setattr(ivf, "BLOCK_PROBES", block)
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((12, 24))
    which = np.where(rng.random(900) < 0.34, 0, rng.integers(0, 12, 900))
    m = centers[which] + 0.25 * rng.standard_normal((900, 24))
    corpus = frame(spark, m).repartition(5)
    path = str(tmp_path / "index")
    ivf.build(corpus, path)
    probes = frame(spark, m[::20], "probe_id")
    exact = vx.search(probes, corpus, 10, 0.2)
    got = ivf.search(probes, path, 10, 0.2)
    share = [r.recall for r in vx.recall(got, exact).collect()]
    assert len(share) == 45 and min(share) >= 0.7 and np.mean(share) >= 0.95
    scores = {(r.probe_id, r.id): r.score for r in exact.collect()}
    assert all(abs(scores[r.probe_id, r.id] - r.score) < 2e-6 for r in got.collect() if (r.probe_id, r.id) in scores)
    n = sum(r.compared for r in ivf.compared(probes, path, 10, 0.2).collect())
    assert n < 0.15 * 45 * 900
    everything = ivf.search(probes, path, 10, 0.2, lists=1000)
    assert sorted((r.probe_id, r.id, r.rank) for r in everything.collect()) == sorted((r.probe_id, r.id, r.rank) for r in exact.collect())


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, 0.0]), (6, [-1.0, 0.1])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    path = str(tmp_path / "odd")
    ivf.build(corpus, path)
    probes = spark.createDataFrame([("a", [2.0, 0.0]), ("b", [1.0]), ("c", None), ("d", [0.0, 0.0])], "probe_id string, embedding array<double>")
    assert [(r.probe_id, r.id) for r in ivf.search(probes, path, 5, 0.5).orderBy("rank").collect()] == [("a", 1), ("a", 5)]
    none = str(tmp_path / "none")
    ivf.build(corpus.limit(0), none)
    assert ivf.search(probes, none, 5, 0.0).collect() == []


def test_plan_and_driver_do_not_grow_with_the_probes(spark, monkeypatch):
    monkeypatch.setattr(vx, "PROBE_BLOCK", 100)
    corpus = frame(spark, np.eye(4))
    sizes = []
    for n in (10, 5000):
        probes = spark.range(n).select(F.col("id").alias("probe_id"), F.array(*[(F.col("id") % 4 == k).cast("double") for k in range(4)]).alias("embedding"))
        got = vx.search(probes, corpus, 1, 0.5)
        sizes.append(len(got._jdf.queryExecution().optimizedPlan().toString()))
        assert got.count() == n and got.where("id <> probe_id % 4").count() == 0
    assert abs(sizes[0] - sizes[1]) < 50
