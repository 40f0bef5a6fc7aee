"""What archives and the secret scan cost per character, with the same rows as before."""

from __future__ import annotations

import json
import time
import zlib

from pyspark.sql import functions as F

from quarry.sources import archive as ar


def _seconds(df):
    def once():
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    return min(once() for _ in range(4))


def test_cleaning_a_payload_costs_little_more_than_dropping_white_space(spark):
    payload = F.repeat(F.sha2(F.col("id").cast("string"), 256), 60_000)
    df = spark.range(0, 4, 1, 4).select(payload.alias("payload")).cache()
    assert df.agg(F.sum(F.length("payload"))).first()[0] == 4 * 64 * 60_000
    space = _seconds(df.select(F.regexp_replace("payload", r"\s+", "")))
    # with ranges in the class, as before: nine times as long
    assert _seconds(df.select(F.regexp_replace("payload", ar.NOT_BASE64_RX, ""))) < 4 * space
    df.unpersist()


def test_characters_beside_the_alphabet_are_passed_over(spark):
    b64 = spark.range(1).select(F.base64(F.lit(bytearray(zlib.compress(json.dumps({"a": "x", "b": "+/="}).encode()))))).first()[0]
    others = [*(chr(i) for i in range(1, 0x250) if not (chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/="))), " ", "K", "Ａ", "\U0001f600", "\0"]
    mixed = "".join(c + "".join(others[i :: len(b64)]) for i, c in enumerate(b64))
    docs = spark.createDataFrame([("p", 0, f"{ar.BLOCK_START}\n{mixed}\n{ar.BLOCK_END}")], "project string, shard int, block string")
    assert sorted((r.status, r.path, r.content) for r in ar.unpack(docs).collect()) == [("legacy", "a", "x"), ("legacy", "b", "+/=")]
    assert spark.range(1).select(F.regexp_replace(F.lit("".join(others) + b64), ar.NOT_BASE64_RX, "")).first()[0] == b64
