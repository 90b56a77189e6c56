"""Quality, packing, decontamination, licenses, token counts: brute force, edge cases, round trips."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pointloom.llm import decontam, licenses, packing, quality, tokenscan
from pointloom.llm.frames import new_path
from pointloom.llm.tokens import WordTokens, default_path

from .conftest import DOCS, as_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    words = WORD.findall(text or "")
    chars = sum(map(len, words))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(tri)
    rep = len({i + k for i, w in enumerate(tri) if often[w] > 1 for k in range(3)})
    return len(words), chars, symbols, dup, rep


def test_base_statistics(odd_rows, words):
    more = ["x\ny\nx\n \nx\r\nx", "a b c d a b c e f", "# $ % <b>|</b>", "a b a b a b", " ".join(words[:30]) + "\n" + " ".join(words[:30])]
    for text in [t for _, t in odd_rows] + more:
        assert quality.base_statistics(text.encode() if text is not None else None) == brute_statistics(text)


def corpus(words, n=120):
    import random

    rng = random.Random(9)
    good = [(i, " ".join(rng.choice(words) for _ in range(90)) + ".") for i in range(n)]
    bad = [(1000 + i, " ".join(rng.choice(words).upper() + "***" for _ in range(90))) for i in range(n // 2)]
    return good + bad


def test_quality_separates_and_covers_all(spark, words):
    rows = corpus(words)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in rows if d % 2 == 0] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    assert got == {d: d < 1000 for d, _ in rows}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows if d < 1000}
    again = quality.fit(docs.repartition(7), labels)
    assert np.allclose(again.log_ratio, model.log_ratio) and again.threshold == model.threshold


def test_quality_counts_are_those_of_brute_force(spark, words):
    rows = corpus(words, 20)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(d, 1) for d, _ in rows[:10]], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    import xxhash

    trusted = {d for d, _ in rows[:10] if not xxhash.xxh3_64_intdigest(str(d).encode()) & 1}
    for d, t in rows:
        np.add.at(raw, quality.feature_buckets(t.encode()), 1)
        if d in trusted:
            np.add.at(target, quality.feature_buckets(t.encode()), 1)
    p = (raw + 1) / (raw.sum() + quality.BUCKETS)
    q = (target + 20 * p * quality.BUCKETS / 16) / (target.sum() + 20 * quality.BUCKETS / 16)
    assert np.allclose(model.log_ratio, np.log(q) - np.log(p))


def test_quality_edges(spark, odd, clashing, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd, none)
    got = quality.judge(clashing, model).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[1].base_failed and not by[1].kept and by[1].n_words == 0 and by[7].kept and by[9].base_failed
    assert quality.keep_good(clashing, model).columns == clashing.columns
    empty = odd.where("false")
    assert quality.judge(empty, quality.fit(empty, none)).count() == 0


def test_threshold_rules():
    assert quality.best_threshold([]) == quality.best_threshold([(1.0, 1)]) == float("-inf")
    assert quality.best_threshold([(1.0, 1), (0.0, 0), (0.5, 1)]) == 0.25


def whole_ids(text):
    return Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_the_tokenizer(odd_rows):
    t = WordTokens.of(default_path())
    texts = [x for _, x in odd_rows if x is not None and len(x) < 5000] + ["Don't I'll we're 'tis o'clock", "ÀÉÎ Straße ŉ ſ İstanbul ªº µ", "á é", "12 3.5 1,000 x2 2x", "it's\n\nhere's", "...!!! ?! '' ``", "ǅ ǆ Σς ὈΔΥΣΣΕΎΣ", "﻿bom ​ zero"]
    for x in texts:
        assert t.ids(x.encode()).tolist() == whole_ids(x), x


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 10_000, 12_288])
def test_lengths(n):
    parts = packing.lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 4096 for p in parts) and parts == sorted(parts, reverse=True)


def test_packing_round_trip(spark, odd, clashing, odd_rows):
    rows = packing.pack(clashing).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert len({r.sequence_id >> 58 for r in rows if r.bucket == 3}) <= 1
    texts = Counter()
    docs: dict = {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for (doc, n), parts in docs.items():
        if doc in (7, None):
            continue
        ids = [i for _, p in sorted(parts) for i in p]
        text = dict(odd_rows)[doc]
        assert len(ids) == n and ids[-1] == 2
        if text is None or len(text) < 5000:
            assert ids[:-1] == whole_ids(text)
        texts[doc] += 1
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * rows[[r.doc_id for r in rows].index(7)].doc_tokens
    d = packing.digest(packing.pack(odd)).where("doc_id = 5").collect()
    full = b"".join(np.frombuffer(r.ids, "<u4").tobytes() for r in sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.start))
    assert [x.ids_crc32 for x in sorted(d, key=lambda x: x.start)] == [zlib.crc32(full[4 * x.start : 4 * (x.start + x.length)]) for x in sorted(d, key=lambda x: x.start)]
    assert packing.pack(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, longest=100)


def brute_contained(docs, items, share=0.8, k=5):
    def grams(t):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        return w

    out = set()
    for d, t in docs:
        w = grams(t)
        for i, x in items:
            v = grams(x)
            if not v or len(w) < min(k, len(v)) or i is None:
                continue
            n = min(k, len(v))
            own = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if len(own & have) >= share * len(own) - 1e-9:
                out.add((d, i))
    return out


def test_decontamination(spark, words, odd, odd_rows, monkeypatch):
    import random

    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 6, 14, 37, 60])))) for i in range(60)] + [(900, None), (901, ""), (None, "x y z"), (902, "two words")]
    docs = list(odd_rows)
    for j in range(150):
        w = [rng.choice(words) for _ in range(rng.choice([5, 50, 400, 4000]))]
        i, x = items[rng.randrange(60)]
        part = (x or "").split()
        if rng.random() < 0.4 and len(part) > 3:
            part[rng.randrange(len(part))] = "changed"
        at = rng.randrange(len(w))
        docs.append((100 + j, " ".join(w[:at] + (part if rng.random() < 0.7 else []) + w[at:]).upper()))
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == brute_contained(docs, items)
    small = set()
    uris = decontam.blocks(b, most=100)
    for uri in uris:
        small |= {(doc, i) for doc, t in docs for i, _, _ in decontam.search(decontam.load(uri), (t or "").encode())}
    assert small == got and len(uris) > 5
    # The documents go through several blocks in turns, of a row each and of all.
    whole = as_rows(decontam.contaminated(d, b))
    for turn in (1, 1 << 30):
        monkeypatch.setattr(decontam, "TURN_BYTES", turn)
        assert as_rows(decontam.contaminated(d, b, most=100)) == whole
        assert as_rows(decontam.keep_clean(d, b, most=100)) == as_rows(decontam.keep_clean(d, b))
    clean = decontam.keep_clean(d, b)
    assert as_rows(clean.select("doc_id")) == sorted(((x,) for x, t in docs if not brute_contained([(x, t)], items)), key=str)


def test_decontamination_edges(spark, odd, clashing, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(odd, none).count() == 0 and decontam.keep_clean(clashing, none).count() == len(odd_rows)
    item = spark.createDataFrame([(1, "two words"), (1, "two  words")], "item_id long, text string")
    assert as_rows(decontam.contaminated(clashing, item).select("doc_id", "item_id")) == [(5, 1)]
    assert decontam.contaminated(odd.where("false"), item).count() == 0


def test_bins_keep_the_bound():
    import math

    for u, hits in ((64, 8), (1024, 1), (32768, 26)):
        b = decontam.bins_for(u, hits)
        a = u / b
        assert (1 - (1 - math.exp(-a)) / a) ** hits <= decontam.MISS * 1.01


EDGE = ".,;:!?()[]{}\"'#*/;%<>-"


def brute_licenses(text, templates, share=0.8):
    clean = [w for w in (w.strip(EDGE) for w in WORD.findall((text or "").lower())) if w]
    out = set()
    for name, t in templates.items():
        v = [w for w in (w.strip(EDGE) for w in t.lower().split()) if w]
        n = min(5, len(v))
        own = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for at in range(max(1, len(clean))):
            have = {tuple(clean[i : i + n]) for i in range(at, min(at + len(v) + 3, len(clean) - n + 1))}
            if own and len(own & have) >= share * len(own) - 1e-9:
                out.add(name)
                break
    return out


def test_licenses_are_found_wherever_they_stand(spark, words, odd_rows):
    import random

    rng = random.Random(4)
    docs = list(odd_rows[:5])
    for j, (name, t) in enumerate(sorted(licenses.TEMPLATES.items()) * 8):
        w = [rng.choice(words) for _ in range(rng.choice([0, 7, 200, 3000]))]
        at = rng.randrange(len(w) + 1)
        docs.append((100 + j, " ".join(w[:at] + t.split() + w[at:])))
    d = spark.createDataFrame(docs, DOCS)
    got = {}
    for r in licenses.scan(d).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert r.containment >= 0.8 and r.n_shared <= r.n_template
    for doc, t in docs:
        want = brute_licenses(t, licenses.TEMPLATES)
        assert want <= got.get(doc, set()), (doc, want)
        assert all(brute_licenses(t, {n: licenses.TEMPLATES[n]}, 0.8) for n in got.get(doc, ()))


def test_licenses_in_source_code_and_more_than_once(spark, words):
    t = licenses.TEMPLATES["apache-2.0-header"].split()
    lines = [" ".join(t[i : i + 6]) for i in range(0, len(t), 6)]
    rows = [(i, "int x;\n" + "\n".join(f"{lead} {x}" for x in lines) + "\n" + tail) for i, (lead, tail) in enumerate([("#", ""), (" *", "*/"), ("//", ""), ("//", "////"), (";;", ""), ("--", "")])]
    filler = " ".join(words[:300])
    rows.append((50, f"{' '.join(t)} {filler} # {' # '.join(t)} {filler} {licenses.TEMPLATES['mit']}"))
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).where("license in ('apache-2.0-header', 'mit')").collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows} and all(r.containment == 1.0 for r in got)
    n = len(t)
    assert sorted((r.license, r.first_word, r.n_words) for r in got if r.doc_id == 50) == [("apache-2.0-header", 0, n), ("apache-2.0-header", n + 301, 2 * n - 1), ("mit", 3 * n + 600, 5)]


def test_license_places_and_edges(spark, clashing, odd):
    d = spark.createDataFrame([(1, "so it says: RELEASED under the MIT License, and more")], DOCS)
    r = licenses.scan(d).collect()
    assert [(x.license, x.first_word, x.n_words) for x in r] == [("mit", 3, 5)]
    assert licenses.scan(clashing).count() == 0 and licenses.scan(odd.where("false")).count() == 0
    assert licenses.scan(d, {"short": "so it", "none": " "}).first().license == "short"
    for q, words_ in ((1, 5), (30, 32), (60, 64)):
        s = 0.8 * q / (2 * words_ + 0.2 * q)
        assert 1 - (1 - s) ** licenses.bands_for(q, words_, 0.8) >= licenses.COLLISION


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_of_files(spark, tmp_path, block):
    sep = 9
    streams = {"a": [1, 2, 9, 9, 3, 9], "b": [9], "c": [5, 5, 5, 5, 5, 5, 5, 9, 1, 1], "d": [], "e": [7]}
    for n, ids in streams.items():
        (tmp_path / n).write_bytes(np.array(ids, "<u2").tobytes() + (b"\1" if n == "a" else b""))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in [*streams, "a"]] + [(None,)], "path string")
    got = as_rows(tokenscan.scan(spark, files, sep, 2, block).selectExpr("right(path, 1)", "ordinal", "start", "n_tokens", "ended"))
    want = []
    for n, ids in streams.items():
        start = k = 0
        for i, x in enumerate(ids):
            if x == sep:
                want.append((n, k, start, i - start, True))
                start, k = i + 1, k + 1
        if start < len(ids):
            want.append((n, k, start, len(ids) - start, False))
    assert got == sorted(want, key=str)


def test_token_counts(spark, odd, clashing, odd_rows):
    t = WordTokens.of(default_path())
    want = sorted(((d, int((t.ids(x.encode() if x else None) != tokenscan.SEPARATOR).sum()), True) for d, x in odd_rows), key=str)
    assert as_rows(tokenscan.document_counts(clashing)) == want
    assert tokenscan.document_counts(odd.where("false")).count() == 0
    many = tokenscan.write_tokens(odd, new_path(spark, "small"), limit=64)
    assert many.select("path").distinct().count() > 1
    assert tokenscan.scan(spark, many, block_bytes=32).join(many, ["path", "ordinal"]).count() == len(odd_rows)


@pytest.mark.parametrize("times", [1, 2, 5])
def test_notices_in_a_row_are_told_apart(times):
    """Every notice, repeated with nothing and with a word between, is so many occurrences at their own places."""
    index = licenses.build(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        n = len(text.split())
        for between in ("", " and", " one two three four five six"):
            gap = len(between.split())
            got = [(first, size) for license, first, size, shared, of in licenses.scan_text(index, (between + " ").join([text] * times).encode()) if license == name and shared == of]
            assert got == [(i * (n + gap), n) for i in range(times)], (name, between)


def test_a_notice_with_moved_parts_is_one():
    index = licenses.build({"x": " ".join(f"w{i}" for i in range(40))})
    moved = [f"w{i}" for i in (*range(20, 40), *range(20))]
    assert [(r[0], r[1], r[2]) for r in licenses.scan_text(index, " ".join(moved).encode())] == [("x", 0, 40)]
