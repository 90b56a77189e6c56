"""Token files keep every token of a text."""

from __future__ import annotations

import pytest
from tokenizers import Tokenizer

from pointloom.llm import tokenscan
from pointloom.llm.frames import new_path
from pointloom.llm.tokens import default_path

from .conftest import DOCS


def test_a_literal_end_of_text_counts(spark):
    text = "a <|endoftext|> b<|endoftext|>"
    t = Tokenizer.from_file(default_path())
    want = len(t.encode(text, add_special_tokens=False).ids)
    assert t.get_vocab_size(with_added_tokens=True) <= tokenscan.SEPARATOR
    docs = spark.createDataFrame([(1, text), (2, "c")], DOCS)
    got = {r.doc_id: r.n_tokens for r in tokenscan.document_counts(docs).collect()}
    assert got[1] == want and len(got) == 2
    with pytest.raises(Exception, match="separator"):
        tokenscan.write_tokens(docs, new_path(spark, "bad"), separator=49_407)
