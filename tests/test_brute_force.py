"""Distributed operators against tiny pure-Python restatements (random inputs)."""

import random

from quarry.operators import context as cx
from quarry.operators import memory as mem


def _seq_pack(files, query, max_tokens, base_tokens):
    """Sequential greedy-skip packing over (score desc, file order)."""
    lq = query.lower()
    terms = set(lq.split())
    scored = []
    for ordv, (path, content) in enumerate(files):
        s = 50 if path.lower() in lq else (30 if path.split("/")[-1].lower() in lq else 0)
        s += sum(1 for t in terms if len(t) > 3 and t in content.lower())
        scored.append((s, ordv, path, content))
    scored.sort(key=lambda x: (-x[0], x[1]))
    cur, out = base_tokens, []
    for s, ordv, path, content in scored:
        cost = len(content) // 4 + 20
        if cur + cost < max_tokens:
            out.append(path)
            cur += cost
        if cur >= max_tokens:
            break
    return out


WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "lambda"]


def test_pack_matches_sequential(spark):
    rnd = random.Random(3)
    for case in range(3):
        files = []
        for i in range(40):
            words = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 400)))
            files.append((f"d{i % 3}/f{i}.py", words))
        query = " ".join(rnd.sample(WORDS, 3)) + f" d0/f{rnd.randint(0, 39)}.py"
        budget = rnd.choice([500, 1500, 4000])
        fdf = spark.createDataFrame([("p", p, i, c) for i, (p, c) in enumerate(files)], "project string, path string, ord long, content string")
        qdf = spark.createDataFrame([(1, "p", query)], "query_id long, project string, text string")
        tree_chars = cx.tree_length(fdf).first()["tree_chars"]
        base = (22 + tree_chars + 2) // 4
        got = [r["path"] for r in cx.pack_context(qdf, fdf, max_tokens=budget).orderBy("score", "ord", ascending=[False, True]).collect()]
        want = _seq_pack(files, query, budget, base)
        assert sorted(got) == sorted(want), (case, budget)


def test_trim_matches_popping_loop(spark):
    rnd = random.Random(5)
    rows, expected = [], {}
    for conv in range(30):
        msgs = [("user" if t % 2 == 0 else "assistant", "x" * rnd.randint(0, 900)) for t in range(rnd.randint(1, 12))]
        for t, (role, text) in enumerate(msgs):
            rows.append((conv, t, role, text))
        kept = list(range(len(msgs)))
        total = lambda ks: sum(len(msgs[k][1]) // 4 for k in ks)
        if total(kept) > 400 and len(kept) > 4:
            while total(kept) > 400 and len(kept) > 4:
                kept.pop(0)
        expected[conv] = kept
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in mem.trim_history(df, max_tokens=400).where("keep").collect():
        got.setdefault(r["conv_id"], []).append(r["turn"])
    for conv, kept in expected.items():
        assert sorted(got.get(conv, [])) == kept
