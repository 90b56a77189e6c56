"""Words that hold special tokens in any case, and counts against the tokenizer itself."""

from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

from pointloom.llm import packing, tokenscan
from pointloom.llm.tokens import WordTokens, default_path

from .conftest import DOCS, as_rows

TEXTS = ["<|ENDOFTEXT|>", "x <|EndOfText|> y", "<|endoftext|>", "A<|endoftext|>B <|STARTOFTEXT|>", "<|startoftext|>Plain WORDS", "<| Endoftext |>", "É<|endoftext|>É İ", "a|b <|> <|x|>", "IT'S <|endOFtext|>'S", "", "plain"]


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizers(encode, text):
    t = WordTokens(default_path())
    for _ in range(2):  # from the tokenizer, then from the table
        assert t.ids(text.encode()).tolist() == encode(text)
    assert t.ids((text + " PLAIN").encode()).tolist() == encode(text + " PLAIN")


def test_the_known_splits_are_those_of_the_file_not_of_its_name(tmp_path, encode):
    (tmp_path / "other.json").write_bytes(open(default_path(), "rb").read())
    t = WordTokens(str(tmp_path / "other.json"))
    assert t._direct and t.ids(b"some words, more.").tolist() == encode("some words, more.")


def test_pieces_and_counts_of_odd_texts(spark, encode, odd_rows):
    rows = [*((i, t) for i, t in enumerate(TEXTS)), *((d, t) for d, t in odd_rows)]
    df = spark.createDataFrame(rows, DOCS)
    assert as_rows(tokenscan.document_counts(df)) == sorted(((d, len(encode(t)), True) for d, t in rows), key=str)
    whole = {}
    for r in packing.pack(df.where("doc_id between 0 and 10"), longest=8).collect():
        whole.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for d, t in rows[: len(TEXTS)]:
        if (d, t) not in odd_rows and d not in {x for x, _ in odd_rows}:
            assert sum((whole[d][s] for s in sorted(whole[d])), []) == encode(t) + [2]


def test_many_empty_texts_in_one_block(spark):
    """A block with very many separators is scanned in linear time, and batches of short pieces stay small."""
    df = spark.range(0, 300_000, 1, 4).selectExpr("id as doc_id", "if(id % 1000 = 0, 'two words', '') as text")
    got = tokenscan.document_counts(df).selectExpr("count(*) n", "sum(n_tokens) t", "count(distinct doc_id) d").first()
    assert (got.n, got.t, got.d) == (300_000, 600, 300_000)
    p = packing.pack(df).selectExpr("count(*) n", "sum(length) t").first()
    assert p.t == 300_000 + 600
