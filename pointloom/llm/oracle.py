"""SQL for DuckDB with the results of those queries that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str) -> str:
    words = _WORDS.format(_LOWER.format("text"))
    return f"""(SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM (SELECT {key}, {words} AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0)"""


JACCARD_JOIN = f"""
WITH RECURSIVE sh AS MATERIALIZED {_shingles("documents", "doc_id")},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
    JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT links.v, reach.c FROM reach JOIN links ON links.u = reach.u)
SELECT d.doc_id, r.c AS class_id, coalesce(k.n, 0) AS n_links
FROM documents d JOIN (SELECT u, min(c) AS c FROM reach GROUP BY u) r ON r.u = d.doc_id
LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) k ON k.u = d.doc_id
"""

_HOST = "translate(coalesce(regexp_extract({0}, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = "(VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(kind, h, p)"


def _rest(url: str) -> str:
    return f"(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END)"


def _parts(select: str, url: str, source: str) -> str:
    rest = _rest(url)
    return f"""(SELECT {select}, {_HOST.format(rest)} AS host, coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path,
        coalesce(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '') AS query FROM {source})"""


_NODE = "CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END"
_PLAIN = r"""CASE WHEN host <> '' THEN host || path
    || CASE WHEN len(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_[a-z]+|ref|fbclid|gclid)$'))) > 0
       THEN '?' || array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '^(utm_[a-z]+|ref|fbclid|gclid)$')), '&') ELSE '' END END"""
_LINK = r"""regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)"""
_REFRESH = r"""regexp_extract(regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)"""


def _ruled(key: str, source: str) -> str:
    """The longest rule of each distinct (host, path) pair."""
    return f"""(SELECT {key}, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS own
        FROM (SELECT DISTINCT {key} FROM {source}) q JOIN {_RULES} ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY {key})"""


#: Classes of the edges ``links`` and what their rules decide for the pages ``node``.
_DECIDED = f"""e AS MATERIALIZED (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
reach AS (SELECT u, u AS c FROM e UNION SELECT e.v, reach.c FROM reach JOIN e ON e.u = reach.u),
member AS MATERIALIZED (SELECT u AS node, min(c) AS alias FROM reach GROUP BY u),
mparts AS MATERIALIZED {_parts("node, alias", "('x://' || node)", "member")},
decided AS (SELECT alias, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS class_verdict
    FROM mparts JOIN {_ruled("host, path", "mparts")} x USING (host, path) GROUP BY alias)
SELECT page_id, host, path, rule, coalesce(own, class_verdict, 'allow') AS verdict, coalesce(alias, node) AS alias, class_verdict
FROM node LEFT JOIN {_ruled("host, path", "node")} x USING (host, path) LEFT JOIN member USING (node) LEFT JOIN decided USING (alias)"""

URL_FILTERS = f"""
WITH RECURSIVE p AS MATERIALIZED {_parts("page_id, url, html", "url", "pages")},
node AS MATERIALIZED (SELECT page_id, host, path, {_NODE} AS node, {_PLAIN} AS plain, html FROM p),
links AS MATERIALIZED (
    SELECT node AS u, plain AS v FROM node
    UNION SELECT u, {_NODE} FROM {_parts("u", "target", f"(SELECT node AS u, {_LINK} AS target FROM node UNION SELECT node, {_REFRESH} FROM node)")}),
{_DECIDED}
"""

#: The edges of pages that :func:`.queries.linked_pages` writes, told by their addresses' parts and not read from tags.
URL_ALIASES = f"""
WITH RECURSIVE one AS (SELECT page_id, min(url) AS url FROM pages GROUP BY page_id),
p AS MATERIALIZED {_parts("page_id, url", "url", "pages")},
node AS MATERIALIZED (SELECT page_id, host, path, {_NODE} AS node FROM p),
q AS (SELECT p.page_id, host, path, {_NODE} AS u, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS folder, p.page_id % 8 AS k, one.url AS next_url FROM p LEFT JOIN one ON one.page_id = p.page_id + 1),
chain AS {_parts("page_id", "next_url", "(SELECT page_id, next_url FROM q WHERE k = 0)")},
links AS MATERIALIZED (
    SELECT u, v FROM (SELECT u, CASE k WHEN 1 THEN host || '/hub/index.html' WHEN 2 THEN 'www.example.com/en/start' WHEN 3 THEN host || path || '?print=1&all=2' WHEN 4 THEN host || folder || 'sub/page.html'
        WHEN 5 THEN host || regexp_replace(folder, '[^/]+/$', '') || 'es/list.html' WHEN 6 THEN 'news.example.net/es/' || regexp_extract(host, '([^.]*)$', 1) END AS v FROM q WHERE k BETWEEN 1 AND 6)
    WHERE u IS NOT NULL
    UNION SELECT u, {_NODE.replace("host", "chain.host").replace("path", "chain.path").replace("query", "chain.query")} FROM q JOIN chain USING (page_id) WHERE u IS NOT NULL AND chain.host <> ''),
{_DECIDED}
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
    CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""

_ESCAPED = "(length({0}) + length(regexp_replace({0}, '[^\\\\#<{1}]', '', 'g')))"
_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

CHAT_FORMATTING = f"""
WITH c AS (
    SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
t AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {_ORDER})) AS turns_sha256,
    CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(x, '' {_ORDER}) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
    CAST(sum(15 + {_ESCAPED.format("r", ":")} + {_ESCAPED.format("x", "")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH d AS {_shingles("documents", "doc_id")}, b AS {_shingles("benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM h JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""

BASE_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 1))) u(i)),
often AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN often USING (doc_id, s), (VALUES (0), (1), (2)) o(k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""

#: CRC-32 of an ASCII text, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384::BIGINT))))"""

UNIGRAM_SCORES = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_CRC.format("doc_id::VARCHAR")} % 7 = 2 AS held_out, list_append({_WORDS.format(_LOWER.format("coalesce(text, '')"))}, '') AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens,
    floor(sum(log10((coalesce(c, 0) + 1) / (n.n + n.v + 1))) * 10000 + 0.5) / 10000 + 0.0 AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""

_EDGE = r"[.,;:!?()\[\]{}\"''#*/;%<>-]"
_PARTED = f"""list_filter(list_transform({_WORDS.format(_LOWER.format("text"))}, lambda s: regexp_replace(regexp_replace(s, '^{_EDGE}+', ''), '{_EDGE}+$', '')), lambda s: s <> '')"""


def _license_hits() -> str:
    """Templates that have a window in a document with four fifths of their shingles; all have five words or more."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    cut = "SELECT {0}, i, array_to_string(w[i:i + 4], ' ') AS s FROM {1}, unnest(range(1, len(w) - 3)) u(i)"
    return f"""
WITH t AS MATERIALIZED (SELECT license, {_PARTED} AS w FROM (VALUES {rows}) v(license, text)),
size AS (SELECT license, CAST(pow(2, ceil(log2(len(w)))) AS BIGINT) AS l FROM t),
ts AS MATERIALIZED (SELECT DISTINCT license, s FROM ({cut.format("license", "t")})), tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
d AS (SELECT doc_id, {_PARTED} AS w FROM documents WHERE text IS NOT NULL),
h AS MATERIALIZED (SELECT doc_id, license, (i - 1) // l AS nr, s FROM ({cut.format("doc_id", "d")}) JOIN ts USING (s) JOIN size USING (license)),
x AS (SELECT doc_id, license, nr + o AS nr, count(DISTINCT s) AS k FROM h, (VALUES (0), (-1)) y(o) GROUP BY ALL)
SELECT DISTINCT doc_id, license FROM x JOIN tn USING (license) WHERE nr >= 0 AND k >= 0.8 * n - 1e-9
"""


#: Terms are runs of a-z and of characters beyond ASCII, once A-Z are lower-cased.
SOURCE_DIVERGENCE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gs AS MATERIALIZED (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(all_total, 0) AS all_total FROM g
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
    LEFT JOIN (SELECT lang, sum(n) AS all_total FROM c GROUP BY ALL) USING (lang) LEFT JOIN (SELECT lang, count(*) AS v FROM k GROUP BY ALL) USING (lang)),
f AS MATERIALIZED (SELECT gs.lang, gs.source, k.term, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p FROM gs JOIN k ON k.lang = gs.lang
    LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = k.term),
q AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN q ON q.lang = a.lang AND q.source = a.source AND q.item = b.source),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(all_total) + any_value(v)) AS q FROM c JOIN gs USING (lang, source) GROUP BY ALL),
term AS (SELECT c.lang, c.source, 'term' AS part, c.term AS item, (p - q) * (p - q) // q AS value
    FROM c JOIN f ON f.lang = c.lang AND f.source = c.source AND f.term = c.term JOIN lp ON lp.lang = c.lang AND lp.term = c.term WHERE p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

FILTER_INTERACTIONS = f"""
WITH x AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
y AS (SELECT doc_id, part, len(w) AS n, len(list_distinct(w)) AS u, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS caps, length(x) AS points,
    regexp_matches(x, '[#$%&*|]') AS symbols, coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS copy FROM x),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(n < 100 AS INT) + 2 * CAST(100 * u < 80 * n AS INT) + 4 * CAST(100 * caps > 10 * points AS INT)
    + 8 * CAST(symbols AS INT) + 16 * CAST(copy AS INT) AS mask, count(*) AS n FROM y LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
s AS MATERIALIZED (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, (VALUES (1), (2), (3), (4), (5)) v(step)),
r AS MATERIALIZED (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM m, s GROUP BY ALL),
h AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM r JOIN h USING (part, bit)
"""


ORACLE = {
    "base_rules": BASE_RULES,
    "unigram_scores": UNIGRAM_SCORES,
    "license_hits": _license_hits(),
    "op2_jaccard_join": JACCARD_JOIN,
    "op4_url_filters": URL_FILTERS,
    "url_aliases": URL_ALIASES,
    "op6_warc": WARC,
    "op7_chat_formatting": CHAT_FORMATTING,
    "op9_decontamination": DECONTAMINATION,
    "op11_source_divergence": SOURCE_DIVERGENCE,
    "op13_filter_interactions": FILTER_INTERACTIONS,
}
