"""Link targets as pages write them: relative, with entities, more than one."""

from __future__ import annotations

from urllib.parse import urljoin

from pointloom.llm import urls

CANONICAL, REFRESH = '<link rel="canonical" href="{}">', '<META http-equiv="Refresh" content="0; url={}">'
BASE = "http://A.org/dir/page?x=1#f"


def edges(spark, rows):
    return {tuple(r) for r in urls.link_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_targets_are_resolved(spark):
    targets = ["/en/x", "page2.html", "//host/x", "./a/../b", "../../up?q=1", "?y=2", "http://Other.net/p", "sub/", "..", "/a/./b/..", "p?to=http://c.net/"]
    for tag in (CANONICAL, REFRESH):
        got = edges(spark, [(i, BASE, tag.format(t)) for i, t in enumerate(targets)])
        want = set()
        for t in targets:
            rest = urljoin(BASE, t).split("://", 1)[1].split("#")[0]
            host, slash, path = rest.partition("/")
            want.add(("a.org/dir/page?x=1", host.lower() + slash + path))
        assert got - {("a.org/dir/page?x=1", "a.org/dir/page?x=1")} == want
    assert edges(spark, [(i, BASE, CANONICAL.format(t)) for i, t in enumerate(["#g", "mailto:me@b.org", "javascript:x", ""])]) == set()
    assert edges(spark, [(1, "http://a.org", CANONICAL.format("x")), (2, "no scheme", CANONICAL.format("/x")), (3, None, CANONICAL.format("/x"))]) == {("a.org", "a.org/x")}


def test_entities_are_decoded_once(spark):
    got = edges(spark, [(1, "http://a.org", CANONICAL.format("http://b.org/?a=1&amp;b=2&#38;c=3&#x26;d=4&amp;amp;&lone&#233;&#x1F389;&#xD800;"))])
    assert got == {("a.org", "b.org/?a=1&b=2&c=3&d=4&amp;&lone" + "\u00e9\U0001f389&")}


def test_all_tags_count_and_decide(spark):
    html = CANONICAL.format("http://b.org/1") + CANONICAL.format("/two") + REFRESH.format("http://c.org/3") + REFRESH.format("four")
    assert edges(spark, [(1, "http://a.org/d/p", html)]) == {("a.org/d/p", v) for v in ("b.org/1", "a.org/two", "c.org/3", "a.org/d/four")}
    pages = spark.createDataFrame([(1, "http://a.org/d/p", CANONICAL.format("//b.net/fr/1"))], "page_id long, url string, html string")
    assert [r.verdict for r in urls.judge(pages, urls.link_edges(pages)).collect()] == ["block"]


def test_rel_may_have_more_words(spark):
    tags = ['<link rel="alternate canonical" href="/1">', "<link href='/2' rel='canonical next'>", "<link rel=canonical href=/3>", '<link rel="not-canonical" href="/4">', '<link rel="canonicals" href="/5">', '<link rel=canonicalx href=/6>']
    assert edges(spark, [(i, f"http://a.org/p{i}", t) for i, t in enumerate(tags)]) == {(f"a.org/p{i}", f"a.org/{i + 1}") for i in range(3)}


def test_decisions_reach_aliases_through_chains_and_hubs(spark):
    """From pages to verdicts, with chains of redirects and a hub, against sets that are joined one by one."""
    import random

    from .conftest import as_rows
    from .test_join_operators import brute_urls

    rng = random.Random(21)
    names = [f"http://{rng.choice('abc')}{i}.{rng.choice(['org', 'net', 'com', 'info'])}/{rng.choice(['fr/', 'es/', '', 'x/'])}{i}" for i in range(120)]
    rows, want = [], set()
    for i, u in enumerate(names):
        html = ""
        if 0 < i < 30:
            html, v = REFRESH.format(names[i - 1]), names[i - 1]  # a chain
        elif 30 <= i < 70:
            html, v = CANONICAL.format(names[30].split(":", 1)[1]), names[30]  # a hub, by a scheme-relative address
        elif rng.random() < 0.4:
            v = u.rsplit("/", 1)[0] + f"/other{i % 7}"
            html = CANONICAL.format(f"other{i % 7}")
        if html and v != u:
            want.add((u.split("://")[1], v.split("://")[1]))
        rows.append((i, u, html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.link_edges(pages)
    assert {tuple(r) for r in got.collect()} == want
    assert as_rows(urls.judge(pages, got).select("page_id", "host", "path", "rule", "verdict")) == brute_urls([r[:2] for r in rows], sorted(want))


def test_aliases_decide_for_pages_without_a_rule(spark):
    """The registered query: pages of hosts without a rule are blocked and allowed through their aliases."""
    from pointloom.llm import queries

    rows = [(i, f"https://h{i % 5}.example.{'org' if i % 3 else 'net'}/{'es' if i % 4 else 'en'}/{i}?a=1&b={i}#x") for i in range(64)] + [(None, "http://x.org/"), (70, None), (71, "no address"), (72, "http://only.org")]
    pages = queries.linked_pages(spark.createDataFrame(rows, "page_id long, url string"))
    got = urls.judge(pages, urls.link_edges(pages)).collect()
    assert len(got) == len(rows)
    unruled = {(r.verdict, r.class_verdict) for r in got if r.rule is None}
    assert {("block", "block"), ("allow", "allow"), ("allow", None)} <= unruled
    for r in got:
        assert r.verdict == ("block" if (r.rule or "").startswith("net/") else "allow" if r.rule else r.class_verdict or "allow")
