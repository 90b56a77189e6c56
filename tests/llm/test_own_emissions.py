"""Words of the language model that emit for themselves."""

from __future__ import annotations

import random
import zlib

from pointloom.llm import hmm

from .conftest import DOCS


def test_every_word_looked_up_has_its_own_emission(spark):
    made = [f"w{i}" for i in range(6000)]
    counts = hmm.word_counts(hmm.rows_of(spark.createDataFrame([(None, " ".join(made))], DOCS)))
    v = hmm.vocabulary(counts)
    assert sorted(int(v.symbol[v.at[w.encode()]]) for w in made) == list(range(1, 6001))


def test_states_tell_rare_words_apart(spark):
    """Two kinds of texts whose rare words end alike: only emissions of their own can tell them apart."""
    rng = random.Random(1)
    common = [f"c{i}" for i in range(4200)]
    kinds = [[f"{k}{i:03d}xyz" for i in range(200)] for k in "ab"]
    ids = [d for d in range(2000) if zlib.crc32(str(d).encode()) % hmm.FOLDS != hmm.HELD_OUT]
    rows = [(None, " ".join(common * 40))]
    rows += [(d, " ".join(rng.choice(kinds[d % 2]) for _ in range(60))) for d in ids[:600]]
    held = [d for d in range(10_000, 11_000) if zlib.crc32(str(d).encode()) % hmm.FOLDS == hmm.HELD_OUT][:40]
    pure = [(d, " ".join(rng.choice(kinds[d % 2]) for _ in range(60))) for d in held[:20]]
    mixed = [(d, " ".join(rng.choice(kinds[i % 2]) for i in range(60))) for d in held[20:]]
    got = {r.doc_id: r.score - r.base_score for r in hmm.score(spark.createDataFrame(rows + pure + mixed, DOCS)).where("held_out").collect()}
    assert min(got[d] for d, _ in pure) > max(got[d] for d, _ in mixed)
