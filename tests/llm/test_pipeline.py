"""The pipeline's stages on planted cases, and the registered queries."""

import collections
import random

import __spark_entry__
import corpus_pipeline
from quarry.llm import neardup, pieces
from tests.llm.test_dedup import brute_components, brute_removed

SF = "/root/testdata/sf0.001"


def planted(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage = say(60)
    rows = [(i, say(120)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # exact copies
    rows += [(200 + i, rows[i + 5][1].replace(" ", "  ", 3) + " one") for i in range(5)]  # near copies
    rows += [(300 + i, say(40) + " " + passage + " " + say(40)) for i in range(4)]
    rows += [(400, None), (401, ""), (402, "too short"), (403, "same words again and again here now " * 20)]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0 if t is None else len(t), i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, target int")


def test_stages(spark):
    docs, kept = planted(spark), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept[name] = {r.doc_id: r for r in out.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = out
    first = kept["quality_rules"]
    assert not {400, 401, 402, 403} & set(first) and set(range(40)) <= set(first)
    want = brute_components([(i, r.text) for i, r in first.items()], neardup.SHINGLE)
    second = kept["near_duplicates"]
    assert set(second) == {i for i, (_, c) in want.items() if c == i} and not set(range(100, 105)) & set(second)
    removed = brute_removed([(i, r.text) for i, r in second.items()])
    third = kept["repeated_passages"]
    assert {i: len(r.text.encode()) for i, r in third.items()} == {i: v[0] - v[1] for i, v in removed.items()}
    assert sum(v[1] > 0 for v in removed.values()) >= 3 and all(r.n_chars == len(r.text) for r in third.values())
    t = pieces.Transducer(open(pieces.default_model(), "rb").read())
    for i, r in kept["encode_pieces"].items():
        assert t.decode(r.ids) in {x.text for x in kept["mix_sources"].values()} or i not in kept["mix_sources"]


def test_empty_table(spark):
    docs = planted(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)}
    out = names["pipeline"](spark, SF).collect()
    assert out and len(collections.Counter(r.doc_id for r in out)) > 50
