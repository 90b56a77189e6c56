"""Decontamination by items without an id, and by items of one shingle in long documents."""

from __future__ import annotations

import numpy as np

from pointloom.llm import decontam
from pointloom.llm.text import mix, shingle_hashes, word_hashes

from .conftest import DOCS, as_rows


def test_items_without_an_id_count_in_keep_clean(spark):
    docs = spark.createDataFrame([(1, "before one two three four five six after"), (2, "nothing of it")], DOCS)
    items = spark.createDataFrame([(None, "one two three four five six"), (7, "not in any")], "item_id long, text string")
    assert as_rows(decontam.keep_clean(docs, items).select("doc_id")) == [(2,)]
    assert decontam.contaminated(docs, items).count() == 0


def test_shingles_that_share_32_bits_are_both_found():
    words = [f"w{i}".encode() for i in range(300_000)]
    top = mix(shingle_hashes(word_hashes(words), 1)) >> np.uint64(32)
    order = np.argsort(top)
    at = np.flatnonzero(np.diff(top[order]) == 0)
    assert len(at)
    pair = [words[order[at[0]]], words[order[at[0] + 1]]]
    index = decontam.build(list(enumerate(pair)))
    assert [i for i, *_ in decontam.search(index, b" ".join(words))] == [0, 1]
