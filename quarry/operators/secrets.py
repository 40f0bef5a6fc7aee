"""Secret scanning and redaction.

Rules are our own (the reference ships none). They are a fixed driver-side list,
applied as one expression per rule: no rule table join, no line explosion for
files without any hit (a combined prefilter runs first).
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.bounded import small
from quarry.operators.postings import occurrences
from quarry.session import stored

REDACTION = "[REDACTED SECRET]"

# Fixed values: (type, regex, capture group holding the value, confidence).
# Patterns avoid look-around so that Java regex and RE2 agree.
RULES = [
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", 0, "high"),
    ("google_api_key", r"AIza[0-9A-Za-z_\-]{35}", 0, "high"),
    ("stripe_secret_key", r"sk_live_[0-9A-Za-z]{24,}", 0, "high"),
    ("openai_api_key", r"sk-[A-Za-z0-9]{32,}", 0, "high"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{36}", 0, "high"),
    ("slack_token", r"xox[abpr]-[A-Za-z0-9\-]{10,}", 0, "high"),
    ("webhook_secret", r"whsec_[A-Za-z0-9]{24,}", 0, "high"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "high"),
    ("jwt", r"eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}", 0, "medium"),
    ("database_url", r"(?:postgres|postgresql|mysql|mongodb|mongodb\+srv)://[^\s:/@]+:([^\s@]+)@", 1, "high"),
    ("assigned_secret", r"(?i)\b(?:password|passwd|secret|token|api_key|apikey|client_secret|auth_token)\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']", 1, "medium"),
]
ANY_RULE = "|".join(f"(?:{rx})" for _, rx, _, _ in RULES)
# Literals at least one of which occurs whenever a rule matches: a cheap
# necessary condition tested before any regex runs.
CASE_HINTS = ["AKIA", "AIza", "sk_live_", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-",
              "whsec_", "-----BEGIN ", "eyJ", "://"]
LOWER_HINTS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
# All of them in one look at the text.
ANY_HINT = f"{'|'.join(map(re.escape, CASE_HINTS))}|(?i:{'|'.join(map(re.escape, LOWER_HINTS))})"


def maybe_secret(c) -> F.Column:
    """True when the text may hold a secret (literal prefilter, then the rules)."""
    t = _c(c)
    low = F.lower(t)
    hint = reduce(lambda a, b: a | b, [t.contains(h) for h in CASE_HINTS] + [low.contains(h) for h in LOWER_HINTS])
    return hint & t.rlike(ANY_RULE)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def _hinted(text_col: str):
    """A task function: the rows whose text has a literal without which no rule matches."""

    def run(batches):
        for b in batches:
            yield b.filter(pc.match_substring_regex(b.column(text_col), ANY_HINT))

    return run


def scan(files: DataFrame, keys=("project", "path"), text_col: str = "content") -> DataFrame:
    """Candidates (keys, line, type, confidence, context, value)."""
    texts = files.select(*dict.fromkeys([*keys, text_col]))
    hit = texts.mapInArrow(_hinted(text_col), texts.schema).where(maybe_secret(text_col))
    lines = hit.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("i", "ctx")).where(maybe_secret("ctx"))
    def tag(t, c):
        return lambda v: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"), v.alias("value"))

    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("ctx", F.lit(rx), g), tag(t, c)) for t, rx, g, c in RULES]))
    out = lines.select(*keys, (F.col("i") + 1).cast("long").alias("line"), F.trim("ctx").alias("context"), F.explode(found).alias("m"))
    return out.select(*keys, "line", "m.type", "m.confidence", "context", "m.value").where(F.length("value") > 0)


def secret_values(files: DataFrame, whitelist=(), text_col: str = "content") -> DataFrame:
    """The distinct values that R1 finds anywhere, without the whitelisted ones."""
    v = scan(files, (), text_col).select("value").distinct()
    return v.where(~F.col("value").isin(*whitelist)) if whitelist else v


def redact_values(files: DataFrame, values: DataFrame, text_col: str = "content") -> DataFrame:
    """Every occurrence of each value, in every file, replaced, longest value first.

    Values meet the files by their rarest gram (``postings``); a file's values are confirmed
    and replaced together. Files are joined with their values by the digest of their content,
    so files without a value are not touched, and equal files are looked up once.
    """
    digest = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    texts = files.where(F.length(text_col) > 0).select(digest.alias("digest"), F.col(text_col).alias("text"))
    hits = occurrences(texts, values.select(F.col("value").alias("string")), ["digest"], confirm=False)
    longest = F.array_sort(F.collect_set(F.struct((-F.length("string")).alias("n"), "string")))
    per = stored(hits.groupBy(F.col("digest").alias("__digest")).agg(F.transform(longest, lambda x: x["string"]).alias("__values")), "values-of")
    text = F.col(text_col)
    held = F.filter("__values", lambda v: F.contains(text, v))
    clean = F.aggregate(held, text, lambda t, v: F.replace(t, v, F.lit(REDACTION)))
    joined = files.join(small(per), digest == F.col("__digest"), "left")
    return joined.withColumn(text_col, F.when(F.col("__values").isNull(), text).otherwise(clean)).select(*[f"`{c}`" for c in files.columns])


def redact(files: DataFrame, whitelist=(), text_col: str = "content") -> DataFrame:
    """R2: every occurrence, in any file, of each non-whitelisted value that R1 finds in any
    file is replaced, longest value first."""
    return redact_values(files, stored(secret_values(files, whitelist, text_col), "values"), text_col)


def scrub(files: DataFrame, text_col: str = "content") -> DataFrame:
    """Unconditional redaction used when rendering."""
    return redact(files, (), text_col)


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Per type and confidence: candidates and distinct values."""
    return candidates.groupBy("type", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("distinct_values"))


def with_preview(candidates: DataFrame) -> DataFrame:
    """X10."""
    return candidates.withColumn("preview", X.secret_preview("value"))
