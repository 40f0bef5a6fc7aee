"""Quality rules, mixing and language identification against plain restatements."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import language, mixing, quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None, None, 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "alpha beta gamma " * 30, "en", "s", 0), (5, " \n\t", None, "s", 0), (6, "x" * 300_000, "de", "t", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, kept int"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


# quality rules


def brute_counts(t):
    w = WORD.findall(t or "")
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality.score(docs, None).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        c = brute_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == c
        assert g.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and g.kept == (not g.base_failed)


def test_forest_finds_labelled_junk(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    forest = quality.fit(docs, labels)
    rows = quality.score(docs, forest).join(labels, "doc_id").where("NOT base_failed").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert np.mean(bad) < 0.3 and np.mean(good) > 0.99
    again = quality.score(docs, quality.fit(docs, labels)).where("kept").count()
    assert again == quality.keep(docs, forest).count()


def test_path_lengths():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 0.1, (400, 2)), [[5, 5], [-4, 3]]))
    score = quality.fit_forest(x).score(x)
    assert set(np.argsort(-score)[:2]) == {400, 401} and ((score > 0) & (score < 1)).all()


def test_quality_odd_rows(spark):
    got = quality.score(odd(spark), None).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 90, False), (1, 0, False), (2, 0, False), (2, 0, False), (5, 0, False), (6, 1, False)]
    assert quality.score(odd(spark).limit(0), None).count() == 0
    assert quality.fit(odd(spark), spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.keep(odd(spark), None).columns == odd(spark).columns


# mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        t = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_brute(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "zz", "\U0001f600", "big"]
    rows = []
    for i in range(400):
        s = rng.choice(sources)
        rows.append((i, " ".join(["w"] * (rng.choice([0, 1, 5, 40]) * (30 if s == "big" else 1))), s))
    docs = spark.createDataFrame([(i, t, s, i) for i, t, s in rows], "doc_id long, text string, source string, target int").repartition(5)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    sizes = {s: sizes[s] for _, _, s in rows}
    want = brute_targets(sizes)
    sized = mixing.sizes(docs)
    plan = mixing.plan(mixing.cut(sized))
    got = mixing.taken(sized, plan).collect()
    source = {i: s for i, _, s in rows}
    took = collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        took[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
    assert all(abs(took[s] - want[s]) <= 1 for s in sizes)
    again = mixing.taken(sized, mixing.plan(mixing.cut(mixing.sizes(docs.repartition(2))))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    mixed = mixing.mix(docs)
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert mixed.columns == docs.columns and all(words[r.doc_id] == r.taken for r in got)


def test_mixing_odd_rows(spark):
    sized = mixing.sizes(odd(spark))
    got = mixing.taken(sized, mixing.plan(sized)).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    empty = mixing.sizes(odd(spark).limit(0))
    assert mixing.taken(empty, mixing.plan(empty)).count() == 0
    blank = odd(spark).where("doc_id < 3")
    assert {r.taken for r in mixing.taken(mixing.sizes(blank), mixing.plan(mixing.sizes(blank))).collect()} == {0}
    assert mixing.first_words(" a  b\nc ", 2) == " a  b" and mixing.first_words("a", 0) == ""


# language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs, language.train(docs)).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_parse_is_longest_match():
    rng = random.Random(3)
    sample = "".join(rng.choice("abcd") for _ in range(400))
    m = language.Model({"x": [sample], "y": ["abab" * 20]})
    text = "".join(rng.choice("abcd") for _ in range(300))
    known = " " + sample + " "

    def phrases(t):
        n = at = 0
        while at < len(t):
            k = 1
            while at + k < len(t) and t[at : at + k + 1] in known:
                k += 1
            at, n = at + k, n + 1
        return n

    symbols = m.symbol_of[[ord(c) for c in text]].astype(np.int32)
    assert m.phrases(symbols, np.array([0]), np.array([len(text)]))[0, 0] == phrases(text)


def test_language_odd_rows(spark):
    docs = odd(spark)
    got = language.identify(docs, language.train(docs)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.lang_pred, r.held_out))
    assert {p for i in (1, 2, 5) for p, _ in by[i]} == {"und"} and not any(h for _, h in by[None])
    assert language.identify(docs.limit(0), language.train(docs)).count() == 0
    none = language.Model({})
    assert none.predict(pa.array(["abc", None, "12"]))[0] == ["und"] * 3
    assert language.Model({"x": ["abc abd"]}).predict(pa.array(["abc", "", "日本"]))[0][1] == "und"


def test_sample_of_distinct_whole_texts(spark):
    """Neither a passage at the start of all texts nor a large group of copies is what is learned."""
    rng = random.Random(6)
    words = {k: ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(150)] for k in ("aa", "bb", "licence")}
    say = lambda k, n: " ".join(rng.choices(words[k], k=n))
    licence, copied = say("licence", 200), say("licence", 400)
    rows = [(i, licence + " " + say(k, 400), k) for i, k in enumerate(["aa", "bb"] * 100)]
    rows += [(1000 + i, copied, "aa") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    texts = [say(k, 30) for k in ["aa", "bb"] * 20]
    assert model.predict(pa.array(texts))[0] == ["aa", "bb"] * 20
    few = docs.where("doc_id >= 1000").union(docs.where("lang = 'bb'"))
    assert [b < 12 for b in language.train(few).bits.tolist()] == [True, False]  # the copies are one text


def test_many_languages_keep_all_rows():
    """Above ten languages every row of the sample is shortened, none is thrown away."""
    assert language.common_size([5, 1, 9, 9], 20) == 7 and language.common_size([3, 3], 6) == 3 and language.common_size([], 6) == 0
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    samples = {f"l{k:02}": [say(800) for _ in range(80)] for k in range(16)}
    m = language.Model(samples)
    # the last row's beginning is one phrase of its language
    for k, lang in enumerate(m.langs):
        symbols = m.symbol_of[[ord(c) for c in samples[lang][-1][:300]]]
        symbols = symbols[language._squeeze(symbols)].astype(np.int32)
        assert m.phrases(symbols, np.array([0]), np.array([len(symbols)]))[k, 0] == 1


@pytest.mark.parametrize("same_text", [True, False])
def test_mixing_meets_targets_where_ids_repeat(spark, same_text):
    rows = [(1, "w " * 30 + ("" if same_text else f"x{k}"), "a") for k in range(200)] + [(2 + k, "w " * 17, "b") for k in range(300)]
    rows += [(900 + k % 7, "v " * (k % 11), "c") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    want = brute_targets(sizes)
    sized = mixing.cut(mixing.sizes(docs))
    per = {r.target: r for r in mixing.plan(sized).collect()}
    took, seen = collections.Counter(), mixing.taken(sized, mixing.plan(sized)).collect()
    assert len(seen) == len(rows) and len(per) == 3
    for r in seen:
        took[round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert all(abs(took[round(want[s], 6)] - want[s]) <= 1 for s in sizes)
    mixed = collections.Counter()
    for r in mixing.mix(docs).collect():
        mixed[r.source] += len(WORD.findall(r.text))
    assert all(abs(mixed[s] - want[s]) <= 1 for s in sizes)
