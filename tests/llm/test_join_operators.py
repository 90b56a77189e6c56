"""Jaccard join, language model, WARC, URL filters, chat formatting, components and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pointloom.llm import chat, hmm, jaccard, urls, warc
from pointloom.llm.components import components
from pointloom.llm.frames import new_path

from .conftest import DOCS, as_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# Components


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)],
    [(random.Random(1).randrange(80), random.Random(i).randrange(80)) for i in range(70)], [(None, 1), (2, None), (3, 4)],
])
def test_components(spark, edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = as_rows(components(spark.createDataFrame(edges, "u long, v long")))
    assert got == sorted(((x, top(x)) for x in list(up)), key=str)


# Jaccard join


def grams(t):
    w = WORD.findall(lower(t))
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_join(rows):
    sets = [grams(t) if d is not None else frozenset() for d, t in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((top(i), top(j)))
                up[y] = x
    low = {}
    for i, (d, _) in enumerate(rows):
        r = top(i)
        low[r] = d if low.get(r) is None else min(low[r], d if d is not None else low[r])
    return sorted(((d, low[top(i)] if d is not None else None, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(words):
    rng = random.Random(8)
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 12, 60, 300]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_join_equals_brute_force(spark, words):
    rows = near_rows(words)
    assert as_rows(jaccard.join(spark.createDataFrame(rows, DOCS))) == brute_join(rows)


def test_join_with_small_buckets_and_chunks(spark, words, monkeypatch):
    """Forced splitting: every bucket above four is split, every leaf above eight is searched in chunks."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rows = near_rows(words)
    got, want = as_rows(jaccard.join(spark.createDataFrame(rows, DOCS), limit=4)), brute_join(rows)
    lost = sum(w[2] - g[2] for g, w in zip(got, want))
    assert all(g[2] <= w[2] for g, w in zip(got, want)) and lost <= 0.001 * sum(w[2] for w in want)


def test_join_edges(spark, odd, clashing, odd_rows):
    assert as_rows(jaccard.join(clashing)) == brute_join(odd_rows)
    assert jaccard.join(odd.where("false")).count() == 0
    kept = jaccard.keep_one(clashing, jaccard.join(clashing, hashes=True))
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d in dict.fromkeys(d for d, _ in odd_rows if d is not None)) + ["None", "None"][:2] or kept.count() == len({d for d, _ in odd_rows if d is not None}) + 2


def test_one_id_with_different_texts(spark, words):
    """Texts of one doc_id that are not alike stay apart, in classes and among the rows that are kept."""
    a, b, c = (" ".join(words[i : i + 60]) for i in (0, 100, 200))
    rows = [(3, a), (7, a + " more"), (7, b), (7, b), (9, c), (9, c + " tail"), (9, None), (9, ""), (12, b + " end")]
    df = spark.createDataFrame(rows, DOCS)
    assert as_rows(jaccard.join(df)) == brute_join(rows)
    kept = as_rows(jaccard.keep_one(df, jaccard.join(df, hashes=True)))
    assert len([r for r in kept if r[0] == 9 and r[1]]) == 1
    assert [r for r in kept if r[0] != 9] == sorted([(3, a), (7, b)], key=str) and {r[1] for r in kept if r[0] == 9 and not r[1]} == {None, ""}


def test_buckets_that_go_on_shrinking_are_split_deeper(spark, monkeypatch):
    """Texts that share half of their words keep large buckets for several levels; no link is lost."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(150):
        own = [f"g{g}x{i}" for i in range(40)]
        for j in range(rng.choice([1, 2, 3])):
            w = common + own
            w[-1 - j] = f"v{j}"
            rows.append((len(rows), " ".join(w)))
    df, seen = spark.createDataFrame(rows, DOCS), []
    real = jaccard._leaves
    monkeypatch.setattr(jaccard, "_leaves", lambda *a: (seen.append(real(*a)), seen[-1])[1])
    want = brute_join(rows)
    for local in (8192, 40, 8):  # in a task each, one level at a time, and both
        monkeypatch.setattr(jaccard, "LOCAL", local)
        seen.clear()
        assert as_rows(jaccard.join(df, limit=8)) == want
        assert max(d for _, d, _ in seen) > 2 and len(seen) > 1


def test_children_of_one_sketch_and_of_many():
    rng = np.random.default_rng(1)
    sk, node = rng.integers(0, 2**32, (50, jaccard.POSITIONS)).astype(np.uint32), jaccard.roots(3, 4)
    member, child = jaccard.children_of(int(node[0]), sk, 0.8)
    for i in range(50):
        assert sorted(child[member == i].tolist()) == sorted(jaccard.children(node, sk[i], 0.8).tolist())


def test_runs_of_any_number_have_buckets_of_their_own():
    top = jaccard.roots(0, 5000)
    assert len(np.unique(top)) == 5000 and jaccard.roots(70, 90).tolist() == top[70:90].tolist()
    sk = np.random.default_rng(2).integers(0, 2**32, jaccard.POSITIONS).astype(np.uint32)
    below = [np.unique(jaccard.children(top[i : i + 1], sk, 0.8)) for i in range(5000)]
    assert len(np.unique(np.concatenate(below))) == sum(map(len, below)) > 4000


def test_leaves_of_any_depth_only_ask_for_more_runs(spark, words, monkeypatch):
    """Leaves 40 splits deep ask for some 190 runs; no link is lost and nothing stops."""
    rows, real, asked = near_rows(words)[:60], jaccard._leaves, []

    def deep(reps, threshold, first, runs, *more):
        asked.append((first, runs))
        leaves, depth, _ = real(reps, threshold, first, runs, *more)
        return (leaves, 40, reps.select("fp")) if len(asked) < 3 else (leaves, depth, None)

    monkeypatch.setattr(jaccard, "_leaves", deep)
    assert as_rows(jaccard.join(spark.createDataFrame(rows, DOCS))) == brute_join(rows)
    assert asked == [(0, jaccard.runs_for(depth=2)), (jaccard.runs_for(depth=2), jaccard.runs_for(depth=40))] and asked[1][1] > 128


@pytest.mark.parametrize("sent", [0, 200_000])
def test_sets_are_sent_or_shuffled_alike(spark, words, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT_ROWS", sent)
    rows = near_rows(words)
    assert as_rows(jaccard.join(spark.createDataFrame(rows, DOCS))) == brute_join(rows)


def test_one_row_of_each_class_stays(spark, words):
    """Repeated rows, and columns of every name that the operator uses itself."""
    a, b = " ".join(words[:60]), " ".join(words[60:120])
    rows = [(1, a, "r")] * 5 + [(2, a + " x", "r"), (4, b, "r"), (4, b, "r"), (5, None, "r"), (5, None, "r"), (6, "", "r"), (None, a, "r"), (None, a, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string").selectExpr("*", "'h' as _hash", "1 as class_id", "2 as h", "3 as n", "4 as x", "5 as component", "6 as text_hash", "7 as `a b`")
    kept = jaccard.keep_one(df, jaccard.join(df, hashes=True))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (4, b), (5, None), (6, ""), (None, a), (None, a)], key=str)


def test_runs_reach_the_recall():
    for recall in (0.9, 0.999):
        for depth in (1, 2, 4):
            assert 1 - (1 - jaccard.survival(depth)) ** jaccard.runs_for(recall, depth) >= recall


# Language model


def brute_forward(model, obs):
    """log10 likelihood by sums over all state sequences, step by step without scaling, in logarithms."""
    a = [math.log(model.start[k]) + math.log(model.emit[obs[0], k]) for k in range(len(model.start))]
    for o in obs[1:]:
        a = [math.log(sum(math.exp(a[j]) * model.move[j, k] for j in range(len(a)))) + math.log(model.emit[o, k]) for k in range(len(a))]
    return math.log(sum(map(math.exp, a))) / math.log(10)


@pytest.fixture()
def small_model(monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 5)
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))


def test_forward_and_counts(small_model):
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 7, 7, 1, 20, 600)]
    short = [s for s in seqs if len(s) < 100]
    assert np.allclose(hmm.log_likelihoods(small_model, short), [brute_forward(small_model, s) for s in short])
    assert np.allclose(hmm.log_likelihoods(small_model, seqs, 8), hmm.log_likelihoods(small_model, seqs))
    m = hmm.expected_counts(small_model, seqs)
    assert np.isclose(m.start.sum(), len(seqs)) and np.isclose(m.move.sum(), sum(len(s) - 1 for s in seqs)) and np.isclose(m.emit.sum(), sum(map(len, seqs)))
    assert np.allclose(m.emit.sum(axis=1), np.bincount(np.concatenate(seqs), minlength=5))
    # The gradient of the likelihood by log(start) is the expected start.
    for k in range(3):
        up = hmm.Model(small_model.start.copy(), small_model.move, small_model.emit)
        up.start[k] *= 1 + 1e-6
        d = (hmm.log_likelihoods(up, seqs).sum() - hmm.log_likelihoods(small_model, seqs).sum()) * math.log(10) / 1e-6
        assert abs(d - m.start[k]) < 1e-4
    for limit in (7, 8, 64, 599, 600):  # texts longer than a span are counted span by span, as if whole
        cut = hmm.expected_counts(small_model, seqs, limit)
        assert np.allclose(cut.start, m.start) and np.allclose(cut.move, m.move) and np.allclose(cut.emit, m.emit)
    parts = [hmm.expected_counts(small_model, [s]) for s in seqs]
    assert np.allclose(sum(p.emit for p in parts), m.emit) and np.allclose(sum(p.move for p in parts), m.move)


def brute_base(rows):
    train = [(d, t) for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter()
    for _, t in train:
        c.update(WORD.findall(lower(t)))
        c["\0end"] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        tokens = WORD.findall(lower(t)) + ["\0end"]
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), 5)))
    return sorted(out, key=str)


def lm_rows(words):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        pool = words[: 40] if i % 2 else words[40:80]
        rows.append((i, " ".join(rng.choice(pool) if rng.random() < 0.9 else rng.choice(words).title() for _ in range(rng.choice([0, 1, 30, 120])))))
    return rows


def test_base_scores_and_rare_words(spark, words, clashing, odd_rows, monkeypatch):
    for rows, df in ((lm_rows(words), None), (odd_rows, clashing)):
        df = spark.createDataFrame(rows, DOCS) if df is None else df
        got = as_rows(hmm.score(df).selectExpr("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 5)"))
        for a, b in zip(got, brute_base(rows)):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3


def test_states_learn_held_out_texts(spark, words):
    df = hmm.score(spark.createDataFrame(lm_rows(words), DOCS)).where("held_out and n_tokens > 20").toPandas()
    assert len(df) and (df.score > df.base_score).mean() > 0.9 and np.isfinite(df.score).all()


def test_shares_of_words_sum_to_one(spark, words):
    """In every class the shares of its known words and of one unknown word."""
    rows = hmm.rows_of(spark.createDataFrame(lm_rows(words), DOCS))
    counts = hmm.word_counts(rows)
    v = hmm.vocabulary(counts)
    total = Counter()
    for r in counts.where("length(word) > 0").collect():
        w = bytes(r.word)
        i = v.at.get(w)
        s = int(v.symbol[i]) if i is not None else hmm.tail_class(w)
        if s > hmm.HEAD:
            total[s] += r.c + 1
    for s, mass in total.items():
        assert abs(10 ** v.log_z[s] - (mass + 1)) < 1e-6


def test_more_equally_frequent_words_than_are_looked_up(spark, monkeypatch):
    """Of a bin of counts that is larger than the look-up table a part is taken, as many as there is room."""
    for name, n in (("LOOKUP", 64), ("HEAD", 64), ("SYMBOLS", 1 + 64 + hmm.TAIL)):
        monkeypatch.setattr(hmm, name, n)
    counts = spark.createDataFrame([(f"w{i}".encode(), 3) for i in range(500)] + [(b"often", 90), (b"", 4)], "word binary, c long")
    v = hmm.vocabulary(counts)
    assert 40 <= len(v.at) <= 64 and b"often" in v.at and (v.tokens, v.words, v.ends) == (1594, 502, 4)
    assert abs(v.mass.sum() - 1594) < 1e-6


def test_language_model_edges(spark, odd):
    assert hmm.score(odd.where("false")).count() == 0
    none = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2]
    only = hmm.score(spark.createDataFrame([(d, "some words") for d in none[:3]], DOCS)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0 and np.isfinite(r.score) for r in only)


# WARC


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def salvaged(data):
    out = list(warc.salvage(Bytes(data), len(data)))
    at = 0
    for a, n, _, _ in out:
        assert a >= at or a + n == at
        at = max(at, a + n)
    assert at == len(data)
    return [r["record_id"] for *_, r in out if r], [(a, n) for a, n, why, r in out if why]


@pytest.fixture(scope="module")
def members():
    rng = random.Random(3)
    return [warc.record(i, f"http://h/{i}", bytes(rng.randrange(256) for _ in range(rng.choice([0, 50, 5000]))) + b"WARC/1.1\r\n\x1f\x8b\x08", "response", None) for i in range(12)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(members, packed):
    parts = [warc.gzipped(m) if packed else m for m in members]
    ids = [f"<urn:page:{i}>" for i in range(12)]
    assert salvaged(b"".join(parts)) == (ids, [])
    starts = np.cumsum([0] + [len(p) for p in parts])
    for hurt in range(12):
        broken = list(parts)
        b = bytearray(parts[hurt])
        b[len(b) // 2 if packed else -6] ^= 0xFF
        broken[hurt] = bytes(b)
        got, gaps = salvaged(b"".join(broken))
        assert got == ids[:hurt] + ids[hurt + 1 :] and gaps == [(starts[hurt], len(parts[hurt]))]
        cut = b"".join(parts[:hurt]) + parts[hurt][: len(parts[hurt]) // 3] + b"".join(parts[hurt + 1 :])
        assert salvaged(cut)[0] == ids[:hurt] + ids[hurt + 1 :]
    assert salvaged(b"".join(parts)[:-5])[0] == ids[:-1]
    assert salvaged(b"junk" + b"".join(parts) + b"\x1f\x8b\x08more")[0] == ids
    assert salvaged(b"") == ([], []) and salvaged(b"nothing")[1] == [(0, 7)]


def test_members_of_many_records_and_other_readers(members):
    assert salvaged(warc.gzipped(b"".join(members)))[0] == [f"<urn:page:{i}>" for i in range(12)]
    assert gzip.GzipFile(fileobj=io.BytesIO(b"".join(map(warc.gzipped, members)))).read() == b"".join(members)


def test_gap_longer_than_a_chunk(members, monkeypatch):
    monkeypatch.setattr(warc, "_CHUNK", 512)
    junk = bytes(random.Random(1).randrange(256) for _ in range(5000))
    a, b = map(warc.gzipped, members[:2])
    assert salvaged(a + junk + b) == (["<urn:page:0>", "<urn:page:1>"], [(len(a), 5000)])


def brute_warc(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        later = f is not None and f != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if later else "response", f if later else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/\n{i}%", "é" * 60 if i % 3 == 0 else "x" * 99 if i % 3 == 1 else f"<p>{i}</p>" * 40) for i in range(40)] + [(50, None, None), (51, "", ""), (None, "u", "é" * 60), (3, "again", "é" * 60), (-7, "minus", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as kind", "'d' as digest", "1 as first", "2 as n")
    assert as_rows(warc.round_trip(df)) == brute_warc(rows)
    assert warc.round_trip(df.where("false")).count() == 0
    files = warc.write(warc.with_revisits(df), new_path(spark, "w"), limit=2000, compress=False)
    assert files.count() > 1
    back = {r.record_id: bytes(r.payload) for r in warc.read(files).where("record_type = 'response'").collect()}
    assert back["<urn:page:2>"] == b"<p>2</p>" * 40


# URL filters


def brute_urls(rows, edges):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        return lower(m[1]), m[2]

    def rule(h, p):
        fit = [(len(a + b), a + b, k) for k, a, b in urls.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fit)[1:] if fit else (None, None)

    out = []
    for i, u in rows:
        h, p = parts(u)
        name, verdict = rule(h, p)
        if verdict is None:
            cls, todo = set(), [h + p]
            while todo:
                x = todo.pop()
                if x not in cls:
                    cls.add(x)
                    todo += [b for a, b in edges if a == x] + [a for a, b in edges if b == x]
            own = {rule(*parts("x://" + x))[1] for x in cls} if len(cls) > 1 else set()
            verdict = "allow" if "allow" in own or "block" not in own else "block"
        out.append((i, h, p, name, verdict))
    return sorted(out, key=str)


def test_url_filters(spark):
    rows = [(1, "http://A.Example.com/en/x?q#f"), (2, "https://www.example.com/en/"), (3, "x://example.com/de"), (4, "http://b.net/fr/1"), (5, "http://c.org/1"), (6, "http://d.org/2"), (7, "http://e.org/3"), (8, None), (9, "no scheme"), (10, "://"), (11, "http://notexample.com/en/"), (12, "http://net/es/"), (13, "http://f.org/4"), (5, "http://c.org/1"), (14, "http://x.y/p?a=b://c.net/fr/")]
    edges = [("c.org/1", "b.net/fr/1"), ("d.org/2", "c.org/1"), ("d.org/2", "e.org/3"), ("f.org/4", "b.net/fr/1"), ("f.org/4", "good.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as node", "2 as host", "3 as verdict")
    got = urls.judge(pages, spark.createDataFrame(edges, "u string, v string"))
    want = brute_urls(rows, edges)
    assert as_rows(got.select("page_id", "host", "path", "rule", "verdict")) == want
    by = {r.page_id: r.verdict for r in got.collect()}
    assert by[4] == "block" and by[5] == by[7] == by[13] == "allow"
    lone = urls.judge(pages, spark.createDataFrame(edges[:3], "u string, v string"))
    assert {r.page_id: r.verdict for r in lone.collect()}[7] == "block"
    none = spark.createDataFrame([], "u string, v string")
    assert urls.judge(pages, none).count() == len(rows) and urls.judge(pages.where("false"), none).count() == 0


def test_links_are_read_from_pages(spark):
    html = ['<link rel="canonical" href="http://B.org/x?k=1#f">', "<LINK HREF='http://c.org/' REL=canonical>", '<meta http-equiv="refresh" content="0; url=http://d.org/n">', "<p>", None]
    pages = spark.createDataFrame([(i, f"http://a.org/{i}.html?utm_source=y&k={i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {(r.u.split("?")[0], r.v) for r in urls.link_edges(pages).collect()}
    assert got == {("a.org/0.html", "b.org/x?k=1"), ("a.org/1.html", "c.org/"), ("a.org/2.html", "d.org/n")}
    assert {(r.u.split("?")[0], r.v) for r in urls.variant_edges(pages).collect()} == {(f"a.org/{i}.html", f"a.org/{i}.html?k={i}") for i in range(5)}


# Chat


def test_chat_round_trip(spark):
    tricky = ["", None, "\\### Assistant: </turn> ok", "\\b\\h\\l \\\\ # < > ###", "a </turn>\n### User: b", "🎉é\u0000x", " lead and trail ", "\n", "\\c:"]
    roles = ["user", "assistant", "system", "assi:stant", "", None]
    rows = [(c, t, roles[(c + t) % 6] if c else ("user", "assistant")[t % 2], tricky[(c * 3 + t) % 9]) for c in range(12) for t in range(c % 7 + 1)] + [(None, 0, "user", "lost"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as leaf", "'x' as tree")
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    want = []
    for c in range(12):
        turns = sorted((r for r in rows if r[0] == c), key=key)
        text = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in turns)
        loss = "".join(x or "" for _, _, r, x in turns if r == "assistant")
        want.append((c, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    out = chat.format_paths(chat.linear_tree(df))
    assert as_rows(chat.digest(out).drop("formatted_chars")) == sorted(want, key=str)
    assert chat.digest(chat.format_paths(chat.linear_tree(df.where("false")))).count() == 0


def test_reply_trees(spark):
    nodes = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", -1.0), (1, 2, 0, "assistant", "good", 3.0), (1, 3, 2, "user", "more", 0.0), (1, 4, 3, "assistant", "end", 1.0), (1, 5, 3, "assistant", "other", 2.0), (2, 0, 99, "user", "orphan", 0.0), *((3, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70))]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    paths, _ = chat.leaf_paths(df)
    assert as_rows(paths) == sorted([(1, 1, 2, -1.0), (1, 4, 4, 4.0), (1, 5, 4, 5.0), (2, 0, 1, 0.0), (3, 69, 70, 0.0)], key=str)
    best = {r.tree: r.formatted for r in chat.format_paths(df).collect()}
    assert best[1] == "### user: q </turn>\n### assistant: good </turn>\n### user: more </turn>\n### assistant: other </turn>\n"
    assert best[3].count("</turn>") == 70
    every = chat.format_paths(df, branches=None)
    assert every.count() == 5 and [r.leaf for r in every.where("tree = 1").orderBy("rank").collect()] == [5, 4, 1]
    loop = spark.createDataFrame([(1, 0, 1, "u", "a", 0.0), (1, 1, 0, "u", "b", 0.0)], df.schema)
    with pytest.raises(ValueError):
        chat.leaf_paths(loop, rounds=4)


def test_digests_are_sent_or_shuffled_alike(spark):
    """Pages with repeated payloads, with and without an id, short ones and nulls, by both plans."""
    long = ["x" * 100, "é" * 60, "y" * 150]
    rows = [(i, f"http://h/{i}", long[i % 3] if i % 4 else None if i % 8 else "short") for i in range(40)] + [(None, None, long[0]), (3, "http://h/again", long[0]), (-5, "http://h/first", long[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    sent, shuffled = (as_rows(warc.with_revisits(df, most=most).select("page_id", "url", "kind", "refers_to")) for most in (100, 0))
    assert sent == shuffled and len(sent) == len(rows) and {r[3] for r in sent} >= {-5, 2}


# Pipeline


def test_pipeline_stages(spark, words, tmp_path):
    from .test_text_operators import brute_contained, corpus

    rows = corpus(words, 60)
    text = dict(rows)
    rows += [(2000, text[3]), (2001, text[4].replace(" ", "  ")), (2002, text[5] + " " + " ".join(words[:14]))]
    extra = [(d, t, "en", "src", len(t)) for d, t in rows]
    spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in rows if d % 2 == 0 and d < 2000], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, " ".join(words[:14]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [(d, t) for d, t in rows if not 1000 <= d < 2000]
    keep = {c for _, c, _ in brute_join(good)}
    assert got == {d for d, t in good if d in keep and not brute_contained([(d, t)], items)}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


NAMES = ["_key", "_hash", "h", "n", "x", "kept", "score", "class_id", "component", "text_hash", "fp", "node", "item_id", "ids", "start", "bucket"]


def pipeline_tables(spark, folder, rows, labels, items):
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *(f"'{i}' as `{n}`" for i, n in enumerate(NAMES))).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_of_odd_rows(spark, words, odd_rows, tmp_path):
    """Null, empty, repeated and very long rows and clashing names through all stages; pieces and checksums against the tokenizer."""
    from tokenizers import Tokenizer

    from pointloom.llm import packing, quality
    from pointloom.llm.tokens import default_path

    from .test_text_operators import brute_contained, corpus

    rows = corpus(words, 40)
    rows += [*odd_rows, rows[0], rows[0], (None, rows[1][1]), (None, rows[1][1]), (2000, rows[2][1] + " " + " ".join(words[:14])), (2001, rows[3][1].upper()), (2002, rows[4][1] + " tail")]
    labels = [(d, int(d < 1000), 0) for d, _ in corpus(words, 40) if d % 2 == 0] + [(None, 1, 0), (5, None, None)]
    items = [(1, " ".join(words[:14])), (2, None), (None, ""), (3, "")]
    pipeline_tables(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    verdicts = quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    kept = {(r.doc_id, r.n_words) for r in verdicts.where("kept").collect()}
    good = [(d, t) for d, t in rows if (d, len(WORD.findall(t or ""))) in kept]
    classes = brute_join(good)
    least = {c for _, c, _ in classes}
    one = {(d, t) for d, t in good if d is not None and d in least}
    left = [r for r in [*one, *((d, t) for d, t in good if d is None)] if not brute_contained([(1, r[1])], [(1, items[0][1])])]
    encode, want = Tokenizer.from_file(default_path()), []
    for d, t in left:
        ids, start = np.array([*encode.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for n in packing.lengths(len(ids)):
            want.append((d, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), 0))
            start += n
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "sequence_id").collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(want, key=str)
    assert len({r.sequence_id for r in got}) == len(got) > 30


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
