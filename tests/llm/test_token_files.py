"""Token files against the tokenizers library itself."""

import glob
import random
import zlib

import numpy as np
import pytest

from quarry.llm import shared_files, token_files

tokenizers = pytest.importorskip("tokenizers")


def plain():
    t = tokenizers.Tokenizer.from_file(token_files.default_vocabulary())
    t.encode_special_tokens = True
    return t


def expected(rows):
    t, out, at = plain(), [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, token_files.END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def through(spark, rows, sequence=64):
    folder = shared_files.new_folder(spark, "ids-test")
    docs = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id long, text string, start int").repartition(4)
    n = token_files.write(docs, folder, sequence=sequence)
    got = token_files.read(spark, folder).collect() if n else []
    return folder, n, sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None), [tuple(r) for r in got if r.doc_id is None]


def test_parts_encode_like_whole_texts():
    e, t = token_files.Encoder(open(token_files.default_vocabulary()).read()), plain()
    rng = random.Random(4)
    chars = "abcDE'stl9.,!?#$-     \n\n\t\r\x0b\x0c\x1c\x1f\x85\xa0    ​   　é中\U0001f600"
    texts = ["", " ", "  ", "a  b", "a \n b", " a", "a ", "don't 's", "<|endoftext|> x", None] + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 120))) for _ in range(1500)]
    ids, off = e.encode(texts)
    for k, x in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 2], repr(x)


def test_round_trip(spark):
    rng = random.Random(9)
    rows = [(i * 3, " ".join(rng.choices(["the", "of", "Straße", "\n", "x" * 30, "", "#1"], k=rng.choice([0, 1, 5, 300])))) for i in range(150)]
    rows += [(7, None), (8, ""), (10**12, "the " * 40_000), (30, "again"), (30, "again")]
    folder, n, got, _ = through(spark, rows)
    want = expected(rows)
    assert sorted(got) == sorted(want) and n == sum(w[2] for w in want)
    path = sorted(glob.glob(folder.removeprefix("file:") + "/*.arrow"))[0]
    ids, mask = token_files.sequence_at(path, 0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    assert len(token_files.sequence_at(sorted(glob.glob(folder.removeprefix("file:") + "/*.arrow"))[-1], 300)[0]) == 64


def test_odd_rows(spark):
    _, _, got, null = through(spark, [(None, "x"), (1, None), (2, "")])
    assert null[0][1:3] == (0, 2) and [g[1:3] for g in got] == [(2, 1), (3, 1)]
    assert through(spark, [])[1] == 0


LITERAL = ["<|endoftext|>", "a<|endoftext|>b", "a  <|endoftext|> \n b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x <|endoftext|>\n", "\n\n<|endoftext|>don't<|endoftext|>  "]


def test_added_tokens_as_the_library_does(spark):
    """A literal special token has its own id, as in an untouched tokenizer."""
    raw, t = open(token_files.default_vocabulary()).read(), tokenizers.Tokenizer.from_file(token_files.default_vocabulary())
    own = lambda x: [*t.encode(x, add_special_tokens=False).ids, token_files.END_ID]
    assert 50256 in own(LITERAL[0])
    rng = random.Random(5)
    texts = LITERAL + ["".join(rng.choices(["<|endoftext|>", " ", "\n", "the", "é9", "'s", "<|"], k=rng.randint(1, 30))) for _ in range(300)]
    ids, off = token_files.Encoder(raw, special=True).encode(texts)
    for k, x in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == own(x), repr(x)
    _, _, got, _ = through(spark, list(enumerate(texts)))
    assert [g[2:] for g in sorted(got)] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in map(own, texts)]


def test_added_tokens_that_take_white_space():
    t = tokenizers.Tokenizer.from_file(token_files.default_vocabulary())
    t.add_special_tokens([tokenizers.AddedToken("<mask>", lstrip=True, special=True)])
    t.add_tokens([tokenizers.AddedToken("qux", single_word=True, normalized=False)])
    texts = ["a  <mask> b", "quxes qux  qux", "a b <|endoftext|> c", "plain text", " <mask>", *LITERAL]
    ids, off = token_files.Encoder(t.to_str(), special=True).encode(texts)
    for k, x in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, token_files.END_ID], repr(x)


def test_cuts_against_the_library_on_odd_texts():
    """Ids by parts equal the plain encode of whole texts: signs, digits, quotes and white space of all kinds."""
    import numpy as np
    from tokenizers import Tokenizer

    raw = open(token_files.default_vocabulary()).read()
    plain = Tokenizer.from_str(raw)
    rng = np.random.default_rng(7)
    bits = ["a", "Zed", "é", "ß", "×", "÷", "ÿ", "1", "22", "²", "Ⅷ", "_", "-", "'", "'s", "'ll", "\"", "(", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x85", "\x1c", "\x00", "漢", "𝄞", "<|endoftext|>", "'re", "İ", "ﬁ"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 25)))) for _ in range(4000)] + ["", None, " ", "\n\n", " a", "a ", "  a", "a  "]
    got, off = token_files.Encoder(raw, special=True).encode(texts)
    for k, t in enumerate(texts):
        assert got[off[k] : off[k + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], repr(t)
