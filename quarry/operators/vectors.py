"""Vector search.

Probes are written in blocks that the tasks over the corpus read one at a time, and each
probe keeps its top-k through a window group limit that runs partially before the
shuffle; the approximate search has an index of its own (``ivf.py``). The default
embedding is a deterministic feature-hashing vector built from Spark expressions (no network,
no Python); a caller can plug in any ``pandas_udf`` returning ARRAY<DOUBLE>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.session import scratch_path
from quarry.sources.gather import open_fs

EMBED_DIM = 64
INDEX_MIN_CHARS = 1
DEFAULT_TOP_K = 5
EXPAND_TOP_K = 3
EXPAND_MIN_SCORE = 0.4
#: Probes that a task reads at a time, and those of one matrix product.
PROBE_BLOCK = 32_768
SCORE_COLUMNS = 512


def _hashing_tf(df: DataFrame, text_col: str, out_col: str, dim: int = EMBED_DIM) -> DataFrame:
    """U1 default via spark.ml HashingTF (JVM-side feature hashing of tokens)."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    toks = df.withColumn("_toks", F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 0))
    tf = HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=dim).transform(toks)
    return tf.withColumn(out_col, vector_to_array("_tf")).drop("_toks", "_tf")


def index_keys(files: DataFrame, key=("project", "path")) -> DataFrame:
    """Keys of the rows that get a vector, without computing any."""
    return files.where(F.length("content") >= INDEX_MIN_CHARS).select(*key)


def build_index(files: DataFrame, embed=None, key=("project", "path")) -> DataFrame:
    """V3: X5 input over the whole text, embedding, unit normalisation, size metadata.
    Empty texts and rows whose embedding is null (the plug-in failed) are left out; P8
    flags very long texts, it does not drop them. ``embed`` is any column function (e.g. a
    pandas_udf returning ARRAY<DOUBLE>); the default is feature hashing."""
    f = files.where(F.length("content") >= INDEX_MIN_CHARS)
    f = f.select(*key, X.embed_input(F.col(key[-1]), F.col("content")).alias("_in"), F.length("content").cast("long").alias("size"))
    out = f.select(*key, embed(F.col("_in")).alias("raw"), "size") if embed is not None else _hashing_tf(f, "_in", "raw")
    out = out.where(F.col("raw").isNotNull())
    return out.select(*key, V.normalize(F.col("raw").cast("array<double>")).alias("embedding"), "size")


def embed_texts(df: DataFrame, text_col: str, out_col: str = "embedding", embed=None) -> DataFrame:
    """Embed free text (queries) the same way as the index, unit normalised."""
    if embed is not None:
        e = df.withColumn(out_col, embed(F.col(text_col)))
    else:
        e = _hashing_tf(df, text_col, out_col)
    return e.withColumn(out_col, V.normalize(F.col(out_col).cast("array<double>")))


def matrices(col) -> dict:
    """Row numbers and unit rows of the vectors of each length of an Arrow list column; zero vectors stay zero."""
    import numpy as np
    import pyarrow.compute as pc

    length = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    out = {}
    for n in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == n)
        m = flat[start[rows][:, None] + np.arange(n)]
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        out[n] = rows, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return out


def read_blocks(folder: str, rows: int):
    """Record batches of at most ``rows`` rows of the Parquet files of a shared folder, one at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, base = open_fs(folder)
    for f in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                yield from pq.ParquetFile(source).iter_batches(rows)


def _score_blocks(folder: str, top_k: int, min_score: float, digits: int, names: tuple[str, str], own: bool):
    """A task function: corpus batches (id, embedding) against the probe blocks of a folder."""
    import numpy as np
    import pyarrow as pa

    def scored(ids, corpus, block):
        keys = block.column(0).to_numpy(zero_copy_only=False)
        self_id = block.column(2).to_numpy(zero_copy_only=False)
        sides = matrices(block.column(1))
        for at in range(0, len(keys), SCORE_COLUMNS):
            part = np.arange(at, min(at + SCORE_COLUMNS, len(keys)))
            score = np.zeros((len(part), len(ids)))  # vectors of another length score 0
            for n, (rows, m) in corpus.items():
                if n in sides:
                    mine = np.searchsorted(part, sides[n][0])
                    ok = (mine < len(part)) & (sides[n][0] >= at) & (sides[n][0] <= part[-1])
                    score[np.ix_(mine[ok], rows)] = sides[n][1][ok] @ m.T
            score = np.round(score, digits)
            keep = score >= min_score
            if own:
                keep &= self_id[part][:, None] != ids[None, :]
            # the best top_k of each probe in this batch, ties by id
            order = np.lexsort((np.broadcast_to(ids, score.shape), -np.where(keep, score, -np.inf)), axis=1)[:, :top_k]
            hit = np.take_along_axis(keep, order, axis=1)
            who = np.broadcast_to(np.arange(len(part))[:, None], order.shape)[hit]
            yield keys[part][who], ids[order[hit]], score[who, order[hit]]

    def run(batches):
        for b in batches:
            ids, corpus = b.column(0).to_numpy(zero_copy_only=False), matrices(b.column(1))
            for block in read_blocks(folder, PROBE_BLOCK):
                for who, found, score in scored(ids, corpus, block):
                    cols = [pa.array(who, block.schema.field(0).type), pa.array(found, b.schema.field(0).type), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, "score"])

    return run


def best_of(found: DataFrame, top_k: int, probe_key: str, id_col: str) -> DataFrame:
    """The best ``top_k`` rows of each probe, ties by id; the window's group limit runs before the shuffle too."""
    w = Window.partitionBy(probe_key).orderBy(F.desc("score"), F.asc(id_col))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).withColumn("rank", F.col("rank").cast("long"))


def search(probes: DataFrame, corpus: DataFrame, top_k: int = DEFAULT_TOP_K, min_score: float = 0.0,
           probe_key: str = "probe_id", id_col: str = "id", exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """V4 (and V5 with ``exclude_self``): cosine top-k per probe with an inclusive
    threshold; ties by id.

    A block matrix product: the probes are written as Parquet in the shared folder, and a
    task multiplies each batch of its corpus partition with one block of ``PROBE_BLOCK``
    probes after the other. Neither the driver nor the plan holds a probe, a task holds one
    block and one batch, and only the per-probe top-k of a batch leaves it.
    """
    kinds = dict(probes.dtypes)[probe_key], dict(corpus.dtypes)[id_col]
    own = F.col(id_col) if exclude_self else F.lit(None).cast(kinds[1])
    folder = scratch_path(corpus.sparkSession, "probes")
    probes.select(F.col(probe_key).alias("k"), F.col("embedding").cast("array<double>").alias("v"), own.alias("own")).write.parquet(folder)
    side = corpus.select(id_col, F.col("embedding").cast("array<double>").alias("embedding"))
    task = _score_blocks(folder, top_k, min_score, digits, (probe_key, id_col), exclude_self)
    found = side.mapInArrow(task, f"{probe_key} {kinds[0]}, {id_col} {kinds[1]}, score double")
    return best_of(found, top_k, probe_key, id_col)


def related(seeds: DataFrame, corpus: DataFrame, top_k: int = DEFAULT_TOP_K, min_score: float = 0.0,
            id_col: str = "id") -> DataFrame:
    """V5: neighbours of indexed ids (self excluded; unknown ids give nothing)."""
    s = corpus.join(seeds.select(id_col), id_col, "left_semi").select(F.col(id_col).alias("seed_id"), F.col(id_col), "embedding")
    return search(s, corpus, top_k, min_score, probe_key="seed_id", id_col=id_col, exclude_self=True)


def expand_selection(seeds: DataFrame, corpus: DataFrame, top_k: int = EXPAND_TOP_K,
                     min_score: float = EXPAND_MIN_SCORE, id_col: str = "id") -> DataFrame:
    """V6: V5 per seed (other seeds use up slots), seeds dropped, max score per
    item, best ``2 * top_k`` overall."""
    r = related(seeds, corpus, top_k, min_score, id_col)
    r = r.join(seeds.select(id_col), id_col, "left_anti")
    best = r.groupBy(id_col).agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), F.asc(id_col)).limit(2 * top_k)


def keep_set(seeds: DataFrame, suggestions: DataFrame, corpus: DataFrame, id_col: str = "id") -> DataFrame:
    """O2: seeds ∪ suggestions, restricted to items that exist in the corpus."""
    u = seeds.select(id_col).union(suggestions.select(id_col)).distinct()
    return u.join(corpus.select(id_col), id_col, "left_semi")


def recall(approx: DataFrame, exact: DataFrame, probe_key: str = "probe_id", id_col: str = "id") -> DataFrame:
    """Share of exact top-k hits that the approximate search returned, per probe."""
    hit = exact.join(approx.select(probe_key, id_col, F.lit(1).alias("found")), [probe_key, id_col], "left")
    return hit.groupBy(probe_key).agg((F.sum(F.coalesce("found", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def sync_index(index: DataFrame, actions: DataFrame, files: DataFrame, embed=None) -> DataFrame:
    """V8: re-embed only inserted/updated files, drop deleted ones (the reference
    forgets the vector delete), keep the rest."""
    changed = actions.where(F.col("action").isin("insert", "update")).select("project", "path")
    gone = actions.where(F.col("action").isin("insert", "update", "delete")).select("project", "path")
    kept = index.join(gone, ["project", "path"], "left_anti")
    fresh = build_index(files.join(changed, ["project", "path"], "left_semi"), embed)
    return kept.unionByName(fresh)


def conversation_index(messages: DataFrame, embed=None) -> DataFrame:
    """V9: a vector for every turn of every role: (id, conv_id, turn, role, embedding, size)."""
    m = messages.select("conv_id", "turn", "role", F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("content"))
    idx = build_index(m, embed, key=("conv_id", "turn", "role", "id"))
    return idx.select("id", "conv_id", "turn", "role", "embedding", "size")


def search_conversations(probes: DataFrame, index: DataFrame, top_k: int = DEFAULT_TOP_K, min_score: float = 0.0,
                         roles=None, conversations: DataFrame | None = None) -> DataFrame:
    """V9: search over conversation turns, optionally of some roles or conversations (conv_id)."""
    if roles is not None:
        index = index.where(F.col("role").isin(*roles))
    if conversations is not None:
        index = index.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    return search(probes, index, top_k, min_score)


def rehydrate(hits: DataFrame, store: DataFrame, id_col: str = "path") -> DataFrame:
    """Hits (id, distance) joined to stored content; empty/missing dropped;
    score = 1 - distance."""
    j = hits.join(store.select("project", id_col, "content"), ["project", id_col])
    return j.where(F.length("content") > 0).withColumn("score", 1 - F.col("distance"))
