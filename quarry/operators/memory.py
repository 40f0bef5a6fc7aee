"""Conversation memory.

History trimming is a pure window: a message survives iff the token sum of it and
every later message plus the context fits the limit, or it is among the last
``preserve_recent`` messages (suffix sums only grow towards older messages, so the
oldest-first popping loop removes exactly a prefix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

PRESERVE_RECENT = 4
DEFAULT_MAX_TOKENS = 128000
SUMMARY_HEADER = "Earlier conversation:"


def trim_history(messages: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS, context_tokens: int = 0,
                 preserve_recent: int = PRESERVE_RECENT, key: str = "conv_id", order: str = "turn", block: int = 256) -> DataFrame:
    """Adds ``keep`` (survives trimming). Nothing is trimmed when the total
    fits or when the conversation has at most ``preserve_recent`` messages.

    Suffix sums in two levels: over one row per block of turns, then inside a block, so a
    conversation of any length is spread over many tasks.
    """
    m = messages.withColumn("tokens", X.tokens("text")).withColumn("_b", F.floor(F.col(order) / block))
    per = m.groupBy(key, "_b").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(key).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "_b", F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(key, "_b").orderBy(F.desc(order))
    m = m.withColumns({"_own": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_rank": F.row_number().over(inside)})
    m = m.join(per, [key, "_b"])
    fits = F.col("_t") + F.col("_own") + F.lit(context_tokens) <= F.lit(max_tokens)
    return m.withColumn("keep", F.coalesce(fits, F.lit(False)) | (F.col("_n") + F.col("_rank") <= preserve_recent)).select(
        *messages.columns, "tokens", "keep")


def trim_summary(messages: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS, context_tokens: int = 0,
                 preserve_recent: int = PRESERVE_RECENT, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Summary text of the removed messages per conversation (only those that
    lose at least one message)."""
    t = trim_history(messages, max_tokens, context_tokens, preserve_recent, key, order).where(~F.col("keep"))
    line = F.concat(X.role_label("role"), F.lit(": "), X.message_preview("text"))
    return t.groupBy(key).agg(
        F.count(F.lit(1)).alias("removed"),
        F.concat(F.lit(SUMMARY_HEADER + "\n"), F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda s: s["l"]), "\n")).alias("summary"),
    )


def memory_stats(messages: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS, context_tokens: int = 0,
                 key: str = "conv_id") -> DataFrame:
    """A4: message count, message tokens (sum of per-message floors), totals."""
    s = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("message_count"), F.sum(X.tokens("text")).cast("long").alias("message_tokens")
    )
    total = F.col("message_tokens") + F.lit(context_tokens)
    return s.select(
        key, "message_count", F.lit(context_tokens).cast("long").alias("context_tokens"), "message_tokens",
        total.cast("long").alias("total_tokens"), F.lit(max_tokens).cast("long").alias("max_tokens"),
        F.greatest(F.lit(max_tokens) - total, F.lit(0)).cast("long").alias("available_tokens"),
        (total / F.lit(max_tokens) * 100).alias("usage_percent"),
    )


def transcript(messages: DataFrame, system_prompt: str = "", key: str = "conv_id", order: str = "turn") -> DataFrame:
    """System prompt, then 'User: ...' / 'Assistant: ...' blocks each followed
    by a blank line, ending with 'Assistant:'. Conversations are bounded (trimmed
    to the model window) before this step."""
    line = F.concat(X.role_label("role"), F.lit(": "), F.col("text"), F.lit("\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda s: s["l"]), "")
    return messages.groupBy(key).agg(F.concat(F.lit(system_prompt + "\n\n"), body, F.lit("Assistant:")).alias("prompt"))
