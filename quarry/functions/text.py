"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.paths import suffix

# Fixed values that must equal the reference's behaviour.
CHARS_PER_TOKEN = 4
READ_ERROR_TEXT = "Error: Could not read file"
TIER_1_LIMIT = 32000
TIER_2_LIMIT = 128000
TIER_LABELS = ("TIER_1_FULL", "TIER_2_FULL", "TIER_3_RAG")
SUMMARY_TIER_LABELS = (
    "Small project - fits in all LLMs",
    "Medium project - fits in GPT-4/Claude/Gemini",
    "Large project - may need RAG fallback",
)
RENDER_TIER_LABELS = (
    "WARNING: Exceeds typical 128k context window.",
    "INFO: Fits comfortably in GPT-4 / Claude 3.",
    "OK: Fits in nearly all modern LLMs.",
)
FULL_CONTEXT_SHARE = 0.7
PREVIEW_CHARS = 100
# Glyphs the monospace renderer cannot draw: astral plane, misc symbols, dingbats,
# variation selectors.
UNSAFE_GLYPHS_RX = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """len(text) // 4 (characters, not bytes)."""
    return F.call_function("div", F.length(_c(c)), F.lit(CHARS_PER_TOKEN))


def line_count(c) -> Column:
    """Text.count('\\n') + 1 without materialising a split array."""
    t = _c(c)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")


def char_count(c) -> Column:
    return F.length(_c(c)).cast("long")


def md5_hex(c) -> Column:
    """md5 of the UTF-8 text."""
    return F.md5(_c(c))


def sha256_hex(c) -> Column:
    return F.sha2(_c(c), 256)


def embed_input(path, content, max_chars: int | None = None) -> Column:
    """The text handed to the embedding function: the whole content, or its first
    ``max_chars`` characters if a caller's model asks for that."""
    body = _c(content) if max_chars is None else F.substring(_c(content), 1, max_chars)
    return F.concat(F.lit("File: "), _c(path), F.lit("\n\n"), body)


def glyph_filter(c) -> Column:
    """Undrawable glyphs become '?', NUL characters are dropped."""
    return F.replace(F.regexp_replace(_c(c), UNSAFE_GLYPHS_RX, "?"), F.lit("\u0000"), F.lit(""))


def latin1_fallback(c) -> Column:
    """Characters outside Latin-1 become '?'."""
    return F.regexp_replace(_c(c), r"[^\x{00}-\x{FF}]", "?")


def sanitize_utf8(c) -> Column:
    """Drop NUL and repair invalid UTF-8."""
    return F.replace(F.make_valid_utf8(_c(c)), F.lit("\u0000"), F.lit(""))


def fence_lang(path) -> Column:
    """Lower-case extension without the dot, else 'text'."""
    ext = F.lower(suffix(path))
    return F.when(ext == "", F.lit("text")).otherwise(F.substring(ext, 2, 1 << 30))


def context_tier(n_tokens) -> Column:
    """X9 (inclusive bounds)."""
    n = _c(n_tokens)
    return (
        F.when(n <= TIER_1_LIMIT, TIER_LABELS[0])
        .when(n <= TIER_2_LIMIT, TIER_LABELS[1])
        .otherwise(TIER_LABELS[2])
    )


def summary_tier(n_tokens) -> Column:
    """X9 second label set (strict bounds)."""
    n = _c(n_tokens)
    return (
        F.when(n < TIER_1_LIMIT, SUMMARY_TIER_LABELS[0])
        .when(n < TIER_2_LIMIT, SUMMARY_TIER_LABELS[1])
        .otherwise(SUMMARY_TIER_LABELS[2])
    )


def render_tier(n_tokens) -> Column:
    """X9 third label set (strictly greater, largest first)."""
    n = _c(n_tokens)
    return (
        F.when(n > TIER_2_LIMIT, RENDER_TIER_LABELS[0])
        .when(n > TIER_1_LIMIT, RENDER_TIER_LABELS[1])
        .otherwise(RENDER_TIER_LABELS[2])
    )


def fits_full_context(n_tokens, model_limit: int = 128000) -> Column:
    return _c(n_tokens) <= F.lit(model_limit * FULL_CONTEXT_SHARE)


def secret_preview(c) -> Column:
    """First 8 + '...' + last 4 when longer than 16 characters."""
    v = _c(c)
    return F.when(
        F.length(v) > 16, F.concat(F.substring(v, 1, 8), F.lit("..."), F.substring(v, -4, 4))
    ).otherwise(v)


def message_preview(c) -> Column:
    """X11: first 100 characters plus '...' when longer."""
    t = _c(c)
    return F.when(
        F.length(t) > PREVIEW_CHARS, F.concat(F.substring(t, 1, PREVIEW_CHARS), F.lit("..."))
    ).otherwise(t)


def role_label(role) -> Column:
    return F.when(_c(role) == "user", F.lit("User")).otherwise(F.lit("Assistant"))


def file_label(name, file_id, content) -> Column:
    """X12: '--- FILE: name (id) ---' header over fetched text."""
    return F.concat(F.lit("--- FILE: "), _c(name), F.lit(" ("), _c(file_id).cast("string"), F.lit(") ---\n\n"), _c(content))
