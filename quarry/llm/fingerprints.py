"""Document fingerprints by I-Match with randomised lexicon subsets; DataFrame functions only.

Terms are the distinct lower-cased words of a whole text. The lexicon holds the terms of a band of inverse
document frequency: found in a share of all documents between ``LEAST_SHARE`` and ``MOST_SHARE``. A text's
sorted terms of the lexicon are met with ``SUBSETS`` random subsets of it, and each meeting is hashed. Subsets
come at scales: at scale s a term is in a subset with probability 2**-(s+1). A text of m terms uses the scales
floor(log2 m) and one above, where a subset holds about half a term and a quarter, so that texts of any length
keep some of their hashes when a part of them changes. A fingerprint is the scale and the hashes of both.

Likeness of two fingerprints: at the scales both have, the hashes that are equal, out of the subsets that hold
a term of either; 1 for equal fingerprints, 0 without a common scale. A text without a term of the lexicon
is fingerprinted by all its terms in one hash.

Null texts are empty. Rows that repeat an id and text are one document in the order of documents; a null doc_id
comes before all others. An empty table gives an empty result. The lexicon has at most (mean number of distinct
terms of a document) / ``LEAST_SHARE`` terms at any number of documents; it is broadcast below
``BROADCAST_TERMS`` and joined by key above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, global_rank, store

LEAST_SHARE = 0.001
MOST_SHARE = 0.1
SUBSETS = 32
BROADCAST_TERMS = 1_000_000
#: What parts terms: white space and punctuation.
APART = r"[\x20\x09-\x0D.,;:!?|()\"]+"
_NO_ID = -(1 << 63)
#: The row that carries a document's own facts past the lexicon; no term has this hash but by chance.
_FACTS = 0


def _terms(text: str) -> Column:
    """Hashes of the distinct terms of a text."""
    parts = F.filter(F.array_distinct(F.split(F.lower(F.col(text)), APART)), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2): a key without nulls for each id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(t): hashes of the terms in the band of document frequency."""
    n = docs.count()
    df = docs.select(F.explode(_terms("text")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= least * n) & (F.col("df") <= max(most * n, 1.0))).select("t")


def _fingerprint(df: DataFrame, terms: str, rest: str, name: str) -> DataFrame:
    """df with ``name``: struct(s, low, high, rest) of the sorted array ``terms``; rest is the hash of a text without terms."""
    scale = F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)))).cast("long")
    df = df.withColumn("_s", F.when(F.size(terms) > 0, scale).otherwise(F.lit(-1).cast("long")))
    df = df.withColumn("_m", F.expr("shiftleft(1L, CAST(greatest(_s, 0L) AS INT) + 1) - 1"))
    df = df.withColumn("_low", F.expr(f"transform(sequence(0, {SUBSETS - 1}), j -> filter({terms}, t -> (xxhash64(t, j) & _m) = 0))"))
    df = df.withColumn("_high", F.expr("transform(_low, (x, j) -> filter(x, t -> (xxhash64(t, j) & (_m * 2 + 1)) = 0))"))
    code = "transform({}, x -> IF(size(x) = 0, 0, CAST(xxhash64(x) & 2147483647 AS INT)))"
    made = F.struct(F.col("_s").alias("s"), F.expr(code.format("_low")).alias("low"), F.expr(code.format("_high")).alias("high"), F.when(F.col("_s") < 0, F.col(rest)).alias("rest"))
    return df.withColumn(name, made).drop("_s", "_m", "_low", "_high")


def as_text(fp: str) -> Column:
    """A fingerprint as a string."""
    hexed = [F.array_join(F.transform(F.col(f"{fp}.{c}"), lambda x: F.when(x == 0, F.lit("-")).otherwise(F.lower(F.hex(x)))), ".") for c in ("low", "high")]
    alone = F.concat(F.lit("x"), F.coalesce(F.lower(F.hex(F.col(f"{fp}.rest"))), F.lit("")))
    return F.when(F.col(f"{fp}.s") >= 0, F.concat_ws(":", F.col(f"{fp}.s").cast("string"), *hexed)).otherwise(alone)


def likeness(a: str, b: str) -> Column:
    def share(x: str, y: str) -> Column:
        pairs = f"zip_with({x}, {y}, (p, q) -> IF(p = 0 AND q = 0, -1, IF(p = q, 1, 0)))"
        return F.expr(f"aggregate({pairs}, struct(0 AS same, 0 AS used), (acc, v) -> struct(acc.same + IF(v = 1, 1, 0) AS same, acc.used + IF(v >= 0, 1, 0) AS used), acc -> IF(acc.used = 0, 0D, acc.same / acc.used))")

    sa, sb = F.col(f"{a}.s"), F.col(f"{b}.s")
    return (
        F.when(F.col(a) == F.col(b), F.lit(1.0))
        .when((sa < 0) | (sb < 0), F.when((sa == sb) & F.col(f"{a}.rest").eqNullSafe(F.col(f"{b}.rest")), F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(sa == sb, share(f"concat({a}.low, {a}.high)", f"concat({b}.low, {b}.high)"))
        .when(sa + 1 == sb, share(f"{a}.high", f"{b}.low"))
        .when(sa == sb + 1, share(f"{a}.low", f"{b}.high"))
        .otherwise(F.lit(0.0))
    )


def next_of(rows: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2): for each document the next one in descending order, after the last the first."""
    keys = rows.select("k1", "k2").distinct()
    ranked = cut(global_rank(keys, "k1", "k2"))
    n = ranked.count()
    before = ranked.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), ((F.col("rank") + 1) % max(n, 1)).alias("rank"))
    return ranked.join(before, "rank").select("k1", "k2", "p1", "p2")


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each of ``docs``.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document.
    """
    rows = keyed(docs)
    words = cut(lexicon(rows))
    near = F.broadcast if words.count() <= BROADCAST_TERMS else (lambda df: df)
    order = cut(next_of(rows))
    sized = rows.select("k1", "k2", F.expr("char_length(text) DIV 3").cast("int").alias("third")).distinct()
    asked = order.join(sized, ["k1", "k2"]).select(F.col("p1"), F.col("p2"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), "third")
    heads = rows.select("k1", "k2", "text").join(asked, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")))
    heads = heads.select("o1", "o2", F.expr("substring(text, 1, third)").alias("head")).groupBy("o1", "o2").agg(F.max("head").alias("head"))
    full = rows.select("k1", "k2", "text").join(heads, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")))
    full = full.select("k1", "k2", "text", F.expr("concat(substring(text, 1, char_length(text) - char_length(text) DIV 3), head)").alias("edited"))

    full = full.select(
        "k1", "k2", F.char_length("text").cast("long").alias("n"), F.sha2("edited", 256).alias("sha"),
        _terms("text").alias("own"), _terms("edited").alias("new"),
    )
    xor = "aggregate({}, 0L, (acc, t) -> acc ^ t)"
    none = F.lit(None)
    facts = F.array(F.struct(F.lit(_FACTS).cast("long").alias("t"), F.lit(2).alias("of"), F.col("n"), F.col("sha"), F.expr(xor.format("own")).alias("x0"), F.expr(xor.format("new")).alias("x1")))
    bare = lambda k: (lambda t: F.struct(t.alias("t"), F.lit(k).alias("of"), none.cast("long").alias("n"), none.cast("string").alias("sha"), none.cast("long").alias("x0"), none.cast("long").alias("x1")))
    each = full.select("k1", "k2", F.explode(F.concat(facts, F.transform("own", bare(0)), F.transform("new", bare(1)))).alias("e")).select("k1", "k2", "e.*")
    known = words.union(docs.sparkSession.range(1).select(F.lit(_FACTS).cast("long").alias("t"))).distinct()
    each = each.join(near(known), "t")
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("of") == k, F.col("t"))))
    got = each.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max("sha").alias("sha"), F.max("x0").alias("x0"), F.max("x1").alias("x1"), of(0).alias("own"), of(1).alias("new"))
    got = _fingerprint(_fingerprint(got, "own", "x0", "fp"), "new", "x1", "fe")
    made = store(got.select("k1", "k2", "n", "sha", "fp", "fe"), "fingerprints")

    others = made.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("fp").alias("fn"))
    out = made.join(order, ["k1", "k2"]).join(others, ["p1", "p2"])
    out = out.select("k1", "k2", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("fe").alias("edited_fingerprint"), likeness("fp", "fe").alias("near_edited"), likeness("fp", "fn").alias("near_next"))
    return rows.select("doc_id", "k1", "k2").join(out, ["k1", "k2"]).drop("k1", "k2")
