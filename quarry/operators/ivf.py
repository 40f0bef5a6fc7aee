"""V7: a persistent inverted-file index for approximate cosine search.

Building. Coarse centroids are fitted by spherical k-means on a bounded sample (``SAMPLE_ROWS`` rows, ``SAMPLE_BYTES``
bytes). Every vector goes to the list of its nearest centroid; what the centroid leaves over is kept as one signed byte
per dimension with a scale and the length of the rounding error, beside the vector. Lists are Parquet folders
(``list=K``), and a list of more than ``PIECE_ROWS`` rows is dealt into pieces, so a dense region is no task of its own.

Probing. A probe asks the lists of its nearest centroids, as many as found ``COVER`` of the sample's own neighbours when
the index was fitted. Probes and pieces meet in blocks (list, piece, block of probes). Codes give the cosine up to the
known error, so a vector is compared exactly only if it can still be among the piece's best k and reach the threshold.

Zero vectors and null vectors are in no list. All vectors of an index have one length; others raise ValueError, and
probes of another length find nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.vectors import DEFAULT_TOP_K, best_of, matrices

#: Bounds of the sample that centroids are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
MAX_LISTS = 16_384
ROUNDS = 8
#: Share of the sample's nearest neighbours that the probed lists must hold.
COVER = 0.97
#: Rows of a list, and probes, that meet in one task.
PIECE_ROWS, BLOCK_PROBES = 16_384, 1_024
LISTED = "id {id}, list int, code binary, scale double, error double, unit array<double>"


def fit_centroids(m: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows; an emptied list gets the row that is worst off."""
    rng = np.random.default_rng(seed)
    c = m[np.sort(rng.choice(len(m), min(lists, len(m)), replace=False))]
    for _ in range(ROUNDS):
        near, score = nearest(m, c)
        total = np.zeros_like(c)
        np.add.at(total, near, m)
        empty = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        total[empty] = m[np.argsort(score, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.divide(total, norm, out=c.copy(), where=norm > 0)
    return c


def nearest(m: np.ndarray, c: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of greatest cosine of each row, and that cosine."""
    near, score = np.zeros(len(m), np.int64), np.zeros(len(m))
    for at in range(0, len(m), rows):
        s = m[at : at + rows] @ c.T
        near[at : at + rows] = s.argmax(1)
        score[at : at + rows] = s.max(1)
    return near, score


def lists_to_probe(m: np.ndarray, c: np.ndarray, top_k: int, seed: int, probes: int = 256) -> int:
    """How many lists of some of the sample's rows hold ``COVER`` of their exact neighbours in the sample."""
    rng = np.random.default_rng(seed + 1)
    ask = rng.choice(len(m), min(probes, len(m)), replace=False)
    score = m[ask] @ m.T
    score[np.arange(len(ask)), ask] = -2
    k = min(top_k, len(m) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    near, _ = nearest(m, c)
    place = np.argsort(np.argsort(-(m[ask] @ c.T), axis=1, kind="stable"), axis=1)  # the rank of each list for each probe
    ranks = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(COVER * len(ranks))) - 1)]) + 1


def _assign(centroids):
    """A task function: (id, embedding) -> list, code, scale, error, unit vector."""

    def run(batches):
        c = centroids.value
        for b in batches:
            found = matrices(b.column(1))
            if set(found) - {c.shape[1]}:
                raise ValueError(f"the index holds vectors of {c.shape[1]} dimensions")
            if not found:
                continue
            rows, m = found[c.shape[1]]
            full = (m != 0).any(1)
            rows, m = rows[full], m[full]
            near, _ = nearest(m, c)
            rest = m - c[near]
            scale = np.abs(rest).max(1, initial=0.0) / 127
            code = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
            error = np.linalg.norm(rest - code * scale[:, None], axis=1)
            width = m.shape[1]
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(m.ravel()))
            ids = b.column(0).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(near.astype(np.int32)), codes, pa.array(scale), pa.array(error), unit], names=["id", "list", "code", "scale", "error", "unit"]
            )

    return run


def build(corpus: DataFrame, path: str, lists: int | None = None, id_col: str = "id", top_k: int = 10, seed: int = 7) -> None:
    """Writes the index of ``corpus`` (id, embedding) below ``path``: centroids, lists, and how many lists to probe."""
    spark = corpus.sparkSession
    side = corpus.select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0")
    n, width = side.agg(F.count("*"), F.max(F.size("embedding"))).first()
    sample = side.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * (width or 1)))).toArrow()
    found = matrices(sample.column("embedding").combine_chunks()) if sample.num_rows else {}
    m = found[width][1] if found else np.zeros((0, 1))
    m = m[(m != 0).any(1)]
    lists = lists or int(min(MAX_LISTS, max(1, round(n**0.5)), max(1, len(m) // 16)))
    c = fit_centroids(m, lists, seed) if len(m) else np.zeros((1, width or 1))
    probe = lists_to_probe(m, c, top_k, seed) if len(m) else 1
    id_type = dict(side.dtypes)["id"]
    rows = [(k, v.tolist(), probe, id_type) for k, v in enumerate(c)]
    spark.createDataFrame(rows, "list int, centroid array<double>, probe int, id_type string").write.parquet(f"{path}/centroids")
    kinds = LISTED.format(id=id_type)
    spread = side.mapInArrow(_assign(spark.sparkContext.broadcast(c)), kinds)  # at most MAX_LISTS centroids
    spread = spread.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // PIECE_ROWS)))).cast("int"))
    spread.repartition("part").sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/lists")


def _asked(probes: DataFrame, centroids, count: int, key: str) -> DataFrame:
    """(key, list, v) for each list that a probe asks; probes of another length ask none."""

    def run(batches):
        c = centroids.value
        for b in batches:
            found = matrices(b.column(1)).get(c.shape[1])
            if found is None:
                continue
            rows, m = found
            some = min(count, len(c))
            best = np.argpartition(-(m @ c.T), some - 1, axis=1)[:, :some]
            who = np.repeat(np.arange(len(rows)), some)
            width = m.shape[1]
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(m.ravel()))
            keys = b.column(0).take(pa.array(rows[who]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(best.ravel().astype(np.int32)), unit.take(pa.array(who))], names=["k", "list", "v"])

    side = probes.select(F.col(key).alias("k"), F.col("embedding").cast("array<double>").alias("embedding"))
    return side.mapInArrow(run, f"k {dict(side.dtypes)['k']}, list int, v array<double>")


def _meet(centroids, top_k: int, min_score: float, digits: int, stats: bool):
    """A task function for one piece of a list and one block of its probes."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["k", "n"] if stats else ["k", "id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype=object if c in ("k", "id") else float) for c in names})
        c = centroids.value[int(left["list"].iloc[0])]
        code = np.frombuffer(b"".join(left["code"]), np.int8).reshape(len(left), -1)
        scale, error = left["scale"].to_numpy(), left["error"].to_numpy()
        q = np.stack(right["v"].to_numpy())
        ids, keys = left["id"].to_numpy(), right["k"].to_numpy()
        about = (q @ c)[:, None] + (q @ code.T.astype(np.float64)) * scale
        least, most = about - error, about + error + 0.5 * 10.0**-digits
        floor = np.full(len(q), min_score - 0.5 * 10.0**-digits)
        if least.shape[1] > top_k:  # at least top_k of the piece are this good
            floor = np.maximum(floor, np.partition(least, -top_k, axis=1)[:, -top_k])
        a, b = np.nonzero(most >= floor[:, None])
        if stats:
            return pd.DataFrame({"k": keys, "n": np.bincount(a, minlength=len(keys)).astype(np.int64)})
        unit = np.stack(left["unit"].iloc[np.unique(b)].to_numpy()) if len(b) else np.zeros((0, q.shape[1]))
        score = np.round(np.einsum("ij,ij->i", q[a], unit[np.searchsorted(np.unique(b), b)]), digits)
        hit = score >= min_score
        out = pd.DataFrame({"k": keys[a[hit]], "id": ids[b[hit]], "score": score[hit]})
        return out.sort_values(["k", "score", "id"], ascending=[True, False, True]).groupby("k", sort=False).head(top_k)

    return run


def _pairs(probes: DataFrame, path: str, key: str, top_k: int, min_score: float, digits: int, stats: bool, lists: int | None) -> DataFrame:
    spark: SparkSession = probes.sparkSession
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # at most MAX_LISTS
    c = spark.sparkContext.broadcast(np.array([r.centroid for r in rows]))
    index = spark.read.schema(LISTED.format(id=rows[0].id_type)).parquet(f"{path}/lists")
    asked = _asked(probes, c, lists or rows[0].probe, key).withColumn("h", F.xxhash64("k"))
    # how many pieces a list has, and how many blocks its probes are dealt into; a row per list
    pieces = index.groupBy("list").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_PROBES).cast("int").alias("blocks"))
    dealt = F.broadcast(pieces.join(F.broadcast(blocks), "list"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = index.join(dealt, "list").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("block", every("blocks"))
    right = asked.join(dealt, "list").withColumn("block", F.pmod("h", F.col("blocks")).cast("int")).withColumn("piece", every("pieces"))
    left = left.select("list", "piece", "block", "id", "code", "scale", "error", "unit")
    right = right.select("list", "piece", "block", "k", "v")
    kinds = f"k {dict(asked.dtypes)['k']}, " + ("n long" if stats else f"id {dict(index.dtypes)['id']}, score double")
    by = ["list", "piece", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_meet(c, top_k, min_score, digits, stats), kinds)


def search(probes: DataFrame, path: str, top_k: int = DEFAULT_TOP_K, min_score: float = 0.0, probe_key: str = "probe_id",
           id_col: str = "id", lists: int | None = None, digits: int = 6) -> DataFrame:
    """Approximate top-k of each probe from the index at ``path``: scores are exact, some neighbours may be missed.

    ``lists``: how many lists each probe asks, by default as many as the index found necessary.
    """
    found = _pairs(probes, path, probe_key, top_k, min_score, digits, False, lists).withColumnsRenamed({"k": probe_key, "id": id_col})
    return best_of(found, top_k, probe_key, id_col)


def compared(probes: DataFrame, path: str, top_k: int = DEFAULT_TOP_K, min_score: float = 0.0, probe_key: str = "probe_id",
             lists: int | None = None, digits: int = 6) -> DataFrame:
    """(probe, compared): how many vectors of the index ``search`` compares exactly with each probe."""
    n = _pairs(probes, path, probe_key, top_k, min_score, digits, True, lists)
    return n.groupBy(F.col("k").alias(probe_key)).agg(F.sum("n").alias("compared"))
