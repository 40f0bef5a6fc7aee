"""The literals of the secret rules are looked for in one pass over each text, with the lines found as before."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import secrets as se

ODD = ["K", "ſ", "İ", "é", "\x0b", "\0", "\U0001f600", "\r"]


def _samples():
    value, quoted = "Ab0" * 16, "\"s3cretVal\""
    kept = ["AKIA" + "A0" * 8, "AIza" + "b_-c1" * 7, "sk_live_" + "a" * 24, "sk-" + "Z" * 32, "ghu_" + value[:36], "xoxr-" + "1-" * 5, "whsec_" + "q" * 24,
            "-----BEGIN RSA PRIVATE KEY-----", "eyJ" + ".".join(["aB_-" * 3] * 3), "mongodb+srv://u:p4ss@h", f"PassWord\t:{quoted}", f"x api_key ={quoted}",
            f"AUTH_TOKEN\x0b=\x0c{quoted}", f"client_Secret: {quoted} APIKEY={quoted}"]
    near = ["AKIA", "sk-", "eyJ", "http://a", f"toKen={quoted}", f"paſswd={quoted}", f"token=\n{quoted}", "token = 'short'", "no hint"]
    return [x for s in kept + near for x in (s, f"é{ODD}\n{s}\nlast", f"{s}{''.join(ODD)}", s.swapcase())] + ["", *ODD]


def test_each_hint_is_found_in_any_case_that_counts():
    texts = [f"a{h}b" for h in se.CASE_HINTS] + [h.title() for h in se.LOWER_HINTS] + [h.upper() for h in se.LOWER_HINTS]
    batch = pa.RecordBatch.from_pydict({"content": [*texts, "akia", "Pass word", "", None, "."], "n": range(len(texts) + 5)})
    out = list(se._hinted("content")([batch, batch.slice(0, 0)]))
    assert [x for b in out for x in b.column("content").to_pylist()] == texts
    assert [x for b in out for x in b.column("n").to_pylist()] == list(range(len(texts)))


def test_lines_found_are_those_of_the_rules_alone(spark):
    texts = _samples()
    files = spark.createDataFrame([("p", i, t) for i, t in enumerate([*texts, None])], "project string, n long, content string")
    files = files.select(F.lit("k").alias("fixed"), "n", "content")
    got = sorted((r.n, r.line) for r in se.scan(files, ("fixed", "n")).select("n", "line").distinct().collect())
    alone = files.select("n", F.posexplode(F.split("content", "\n")).alias("l", "line")).where(F.col("line").rlike(se.ANY_RULE))
    assert got == sorted((r.n, r.l + 1) for r in alone.collect()) and len(got) > 40
    values = {r.value for r in se.secret_values(files).collect()}
    assert {"AKIA" + "A0" * 8, "s3cretVal", "p4ss"} <= values and "short" not in values


def test_texts_reach_the_rules_after_one_pass(spark):
    """Before, 23 look-ups a text, six of them on its lower-cased copy, stood before the rules."""
    import contextlib
    import io

    files = spark.createDataFrame([("p", "a", "x")], "project string, path string, content string")
    with contextlib.redirect_stdout(io.StringIO()) as said:
        se.scan(files).explain()
    assert "MapInArrow" in said.getvalue()


def test_a_scan_may_name_the_text_as_a_key(spark):
    files = spark.createDataFrame([(1, "token='longenough'")], "id int, text string")
    assert [tuple(r) for r in se.scan(files, ("text", "id"), "text").select("id", "text", "value").collect()] == [(1, "token='longenough'", "longenough")]
