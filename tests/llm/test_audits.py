"""Source divergence and filter interactions against brute force, with odd rows, ties and clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import divergence, filters

from .conftest import as_rows

TABLE = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, top=200):
    by, occurs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        by[lang or "", source or ""].update(terms)
        occurs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in by}:
        kept = [t for t, n in occurs[lang].items() if n >= 3]
        sources = [g[1] for g in by if g[0] == lang]
        counts = {s: {t: by[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        p_of = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(whole)
        for s in sources:
            pair = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in sources if x != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:last], 1)]
    return sorted(out, key=str)


def grouped(odd_rows, words):
    rng = random.Random(3)
    rows = [(100 + i, " ".join(rng.choice(words[:60]) for _ in range(rng.randint(0, 60))) + " Éa ÉA 日本 x9y", rng.choice(["en", "EN", None, ""]), rng.choice(["s1", "s2", "é", "z", None])) for i in range(200)]
    rows += [(d, t, "xx", "only") for d, t in odd_rows] + [(900, None, "empty", "a"), (901, "12 34", "empty", "b"), (902, "once", "empty", "c")]
    return rows + rows[:20]


def test_divergence_equals_brute_force(spark, odd_rows, words, monkeypatch):
    rows = grouped(odd_rows, words)
    docs = spark.createDataFrame(rows, TABLE).repartition(5)
    want = brute_divergence(rows)
    assert as_rows(divergence.audit(docs)) == want
    assert ("empty", "b", "pair", "a", 0, 1) in want and any(r[2] == "term" for r in want)
    # Counts that are sent on early, texts in small pieces, other tables' columns.
    for name, value in (("HELD", 7), ("PIECE", 16), ("OUT_ROWS", 5)):
        monkeypatch.setattr(divergence, name, value)
    more = docs.select(*(F.lit("x").alias(c) for c in ("term", "n", "docs", "total", "sources", "kept", "a", "b", "x", "y", "rank", "part")), *docs.columns)
    assert as_rows(divergence.audit(more, top=3)) == brute_divergence(rows, 3)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], TABLE)).collect() == []
    assert as_rows(divergence.audit(spark.createDataFrame([(1, None, None, None), (2, "", None, "s")], TABLE))) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_pieces_keep_terms_whole(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 3)
    for text in (b"abcdef gh i jklmnop", b"", b"aaaaaaaaaa", b"  ", "日本語 é".encode()):
        assert b"".join(divergence._pieces(text)) == text
        assert [t for x in divergence._pieces(text) for t in divergence._TERM.findall(x)] == divergence._TERM.findall(text)


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**13 - 1, 10**13, 7)], "n long, total long, kept long")
    assert df.select(divergence._p("n", "total", "kept")).first()[0] == 1 + 10**9 * 10**13 // (10**13 + 7)


def brute_filters(rows, labels):
    good, toxic = ({d for d, *flags in labels if flags[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, text, *_ in rows:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    docs = []
    for d, text, lang, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(f for f, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), d is not None and first[text] < d)) if bad)
        docs.append((lang or "", fails, d in good, d in toxic))
    out = []
    for part in {x[0] for x in docs}:
        mine, rows_of = [x for x in docs if x[0] == part], []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                left = [x for x in mine if not set(x[1]) & set(order[:k])]
                gone = [x for x in left if f in x[1]]
                rows_of.append((part, "".join(order), k + 1, len(left) - len(gone), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == f for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        shapley = Counter()
        for r in rows_of:
            shapley[r[1][r[2] - 1]] += r[4]
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_of]
    return sorted(out, key=str)


def audited(odd_rows, words):
    rng = random.Random(8)
    rows = [(d, t, "odd", None) for d, t in odd_rows]
    for i in range(150):
        pool = words[: rng.choice([20, 400, 900])]
        text = rng.choice([" ", "\n", "\t\x0b"]).join(rng.choice([str.upper, str.title, str])(rng.choice(pool)) + rng.choice(["", "", "", "é", "#", "𝄞"]) for _ in range(rng.choice([3, 99, 100, 160])))
        rows.append((1000 + i, text, rng.choice(["en", "fr", None, ""]), None))
    copies = [(d + 5000, t, lang, None) for d, t, lang, _ in rows[-40:]] + [(3, rows[-1][1], "fr", None), (None, rows[-2][1], "en", None)]
    return rows + copies + rows[-5:]


def test_filters_equal_brute_force(spark, odd_rows, words, monkeypatch):
    rows = audited(odd_rows, words)
    labels = [(d, i % 3 % 2, int(i % 5 == 0)) for i, (d, *_) in enumerate(rows) if i % 2] + [(1001, None, None), (1001, 1, 0), (1001, 0, 1), (None, 1, 1), (77, 1, 1)]
    docs = spark.createDataFrame(rows, TABLE).repartition(6)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute_filters(rows, labels)
    got = filters.audit(docs, known)
    assert as_rows(got) == want and got.count() == 600 * len({r[2] or "" for r in rows})
    monkeypatch.setattr(filters, "PIECE", 64)  # long texts in many pieces
    more = docs.select(*(F.lit(1).alias(c) for c in ("part", "mask", "digest", "k", "n", "good", "toxic", "least", "stay", "quality")), *docs.columns)
    assert as_rows(filters.audit(more, known.withColumn("part", F.lit("x")))) == want


def test_filters_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(spark.createDataFrame([], TABLE), labels).collect() == []
    assert as_rows(filters.audit(spark.createDataFrame([(1, None, None, None), (2, "", "x", None)], TABLE), labels)) == brute_filters([(1, None, None, None), (2, "", "x", None)], [])


@pytest.mark.parametrize("piece", [1, 7, 50, 1 << 20])
def test_statistics_in_pieces(odd_rows, monkeypatch, piece):
    monkeypatch.setattr(filters, "PIECE", piece)
    for _, text in odd_rows:
        raw, words = (text or "").encode(), WORD.findall(text or "")
        got = filters.statistics(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert got.tolist() == [[len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(re.findall("[#$%&*|]", text or "")), len(text or "")]]


def test_words_of_one_hash_are_told_apart():
    texts = [b"ab cd ab ef", b"", b"x" * 70 + b" " + b"y" * 70 + b" " + b"x" * 70, b"cd"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    counts, starts, ends, hashes = filters._scan(data, offsets)
    text = np.repeat(np.arange(4), counts[:, 0])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for h in (hashes, np.zeros_like(hashes), hashes % 2):
        assert filters._distinct(padded, text, starts, ends, h, 4).tolist() == [3, 0, 2, 1]


def test_buffers_of_slices_and_nulls():
    import pyarrow as pa

    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["no", "ab", None, "é", "", "tail"], kind)[1:5]
        data, offsets = filters._buffers(column)
        assert data.tobytes() == "abé".encode() and offsets.tolist() == [0, 2, 2, 4, 4]
