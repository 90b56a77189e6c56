"""Encoding and decoding against the tokenizers library, the transducer against a dictionary, odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointloom.llm import bpe, lexicon

from .conftest import DOCS, as_rows

ODD = [
    "", " ", "  ", "\n", " \n", "\n ", "a  b", "a\n\nb ", "it's  IT'S we'll we'LL 'tis x'd'm'rest's", "''s 's' '' 'll", " 's", "\t's", "don't!'s ?'re", "a <|endoftext|>  b<|endoftext|><|endoftext|> ", "<|ENDOFTEXT|>",
    "x\u0085y z　w᠎​ v", "１２ ½ Ⅷ x²", "日本語 テキスト 𝄞𝄞 🎉🎉🎉 👩‍👩‍👧", "é ﬁ ǅ ͅ", "�﻿\x00\x1c\x1f", "ab'", "'", "s'", "a'l", "'v", " " * 70 + "x", "-" * 300, "'s" * 40, "퟿",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.of(bpe.default_path())


@pytest.fixture(scope="module")
def classes(merges):
    return merges.classes()


@pytest.fixture(scope="module")
def encoder(spark, merges, classes, words):
    known = [*words[:200], *(" " + w for w in words[:300]), " the", "'s", "日本", "\n", "é", " é", "!!", "a" * 48]
    return bpe.Encoder(bpe.default_path(), bpe.compiled(spark, known, classes=classes))


def encoded(encoder, texts):
    return [x.tolist() for x in encoder.ids(iter([None if t is None else t.encode() for t in texts]))]


def test_ids_equal_the_librarys(encoder, library, odd_rows, words):
    texts = [*ODD, *(t for _, t in odd_rows), " ".join(words), "\n".join(w.title() for w in words)]
    for _ in range(2):  # merged, then from the table
        assert encoded(encoder, texts) == [library(t) for t in texts]


PARTS = st.sampled_from([" ", "  ", "\n", "\t", " ", "　", "'", "'s", "'ll", "'re", "a", "B", "é", "語", "1", "½", "!", "-", "#", "́", "𝄞", "the", " the", "<|endoftext|>", "<|", "\x85", " "])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=14).map("".join), st.text(max_size=20)))
def test_any_text(encoder, library, merges, text):
    got = encoded(encoder, [text])[0]
    assert got == library(text)
    assert merges.decoded(np.array(got, "<u4")) == text.encode()


def test_every_character(merges, classes, library, encoder):
    """Each code point behind a letter, a digit, a mark and a space; many at a time."""
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    some = random.Random(2).sample(points, 4000) + list(range(0x2100)) + [0x180E, 0x200B, 0xFEFF, 0xE000, 0x10FFFF]
    texts = [f"a{chr(p)}1{chr(p)}!{chr(p)} {chr(p)}'s{chr(p)} " for p in some]
    assert encoded(encoder, texts) == [library(t) for t in texts]


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_pieces_change_nothing(encoder, library, odd_rows, words, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    texts = [*ODD, " ".join(words[:60]) + "\n\n  x" * 9, "x" * 200, "語 " * 50, None]
    assert encoded(encoder, texts) == [library(t) for t in texts]


def test_decoding_equals_the_librarys(merges):
    t, rng = Tokenizer.from_file(bpe.default_path()), random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(50257), rng.randrange(256), 50256, 60000]) for _ in range(rng.randint(0, 12))]
        assert merges.decoded(np.array(ids, "<u4")).decode("utf-8", "replace") == t.decode(ids, skip_special_tokens=False)


def test_transducer_finds_its_words_and_no_others(tmp_path):
    rng = random.Random(6)
    draw = lambda n: "".join(rng.choice("abcde語𝄞") for _ in range(n))
    words = {draw(rng.randint(1, 7)) + rng.choice(["", "ation", "s", "ing"]): [rng.randrange(99) for _ in range(rng.randint(0, 4))] for _ in range(3000)}
    built = lexicon.build(words | {"": [1]}, np.zeros(lexicon.POINTS, np.uint8))
    lexicon.save(built, f"{tmp_path}/sub/lex")
    for lex in (built, lexicon.load(f"{tmp_path}/sub/lex"), lexicon.load(f"file://{tmp_path}/sub/lex")):
        asked = [*words, *(draw(rng.randint(1, 9)) for _ in range(3000)), "z", "abz", "a" * 99]
        points = np.frombuffer("".join(asked).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) for w in asked])
        found = lex.find(points, ends - [len(w) for w in asked], ends)
        assert [None if k < 0 else lex.ids[lex.id_starts[k] : lex.id_starts[k + 1]].tolist() for k in found.tolist()] == [words.get(w) for w in asked]
        assert sorted(found[: len(words)].tolist()) == list(range(len(words)))  # the outputs number the words
    assert built.n_states < sum(map(len, words)) / 3


def test_transducer_is_minimal():
    arcs, final, _ = lexicon._states(sorted(a + b + c for a in "abcdef" for b in "xyz" for c in "ST"))
    assert len(arcs) == 4 and sum(final) == 1
    assert lexicon.build({}, np.zeros(lexicon.POINTS, np.uint8)).find(np.array([97], np.uint32), np.array([0]), np.array([1])).tolist() == [-1]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_query_of_odd_rows(spark, odd_rows, library, clashing):
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(ODD))]
    want = sorted(((d, len(ids := library(t)), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for d, t in rows), key=str)
    for most in (0, 40, bpe.LEXICON_WORDS):
        assert as_rows(bpe.digest(bpe.encode(spark.createDataFrame(rows, DOCS).repartition(3), most=most))) == want
    assert as_rows(bpe.digest(bpe.encode(clashing))) == sorted((w for w in want if w[0] is None or w[0] < 100 or w[0] > 200), key=str)
    assert bpe.digest(bpe.encode(spark.createDataFrame([], DOCS))).collect() == []


def test_words_are_counted_over_all(spark, words, classes, monkeypatch):
    rows = [(i, " ".join(words[i % 7 : i % 7 + 20])) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    counts = df.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").count().collect()
    whole = sorted(bpe.frequent_words(df, 1000, classes=classes))
    assert {w.strip() for w in whole} == {r.w for r in counts}
    top = bpe.frequent_words(df, 8, classes=classes)
    monkeypatch.setattr(bpe, "HELD", 5)  # counts that are sent on early
    assert bpe.frequent_words(df, 8, classes=classes) == top and sorted(bpe.frequent_words(df, 1000, classes=classes)) == whole


def test_decode_keeps_other_columns(spark):
    df = spark.createDataFrame([("x", bytearray(np.array([15496, 995], "<u4").tobytes()), 1), (None, None, 2), ("z", bytearray(), 3)], "a string, ids binary, `b c` long")
    assert as_rows(bpe.decode(df)) == sorted([("x", "Hello world", 1), (None, None, 2), ("z", "", 3)], key=str)
    assert bpe.decode(df).columns == ["a", "text", "b c"]


def test_other_tokenizers_are_refused():
    from pointloom.llm.tokens import default_path

    with pytest.raises(ValueError):
        bpe.Merges(default_path())
