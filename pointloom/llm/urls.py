"""URL filters over redirect equivalence, in DataFrame operations alone.

Rules name a host suffix and a path prefix.  A url with a fitting rule takes the
verdict of the longest one.  Urls that redirect to each other, or name each other as
canonical, are one alias class (connected components); a url without a rule takes the
verdict of its class: allow where any ruled alias is allowed, else block where any is
blocked, else allow.  Apart from these, and only where the caller adds them, addresses that
differ in tracking parameters alone are taken as variants of one (:func:`variant_edges`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import written

#: (verdict, host suffix, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)$"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node of the alias graph: scheme and fragment dropped, host in lower case; null where it has no host."""
    host, query = host_of(url), query_of(url)
    return F.when(host != "", F.concat(host, path_of(url), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def plain_of(url: Column) -> Column:
    """The address without tracking parameters, which tell where a visitor came from and not what is served."""
    host, path = host_of(url), path_of(url)
    params = F.filter(F.split(query_of(url), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(_TRACKING))
    return F.when(host != "", F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, like ``net/es/``, and its verdict; null where none fits.

    Rules are tried longest first: by host and path together, then host, then in their order.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


_ENTITY = r"(?is)&(?:amp|lt|gt|quot|apos|#\d{1,7}|#x[0-9a-f]{1,6});|[^&]+|&"
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def decoded(text: Column) -> Column:
    """Numeric character references and those of XML's five names as their characters, each once."""

    def one(t: Column) -> Column:
        low = F.lower(t)
        hexed = F.upper(F.lpad(F.regexp_extract(low, r"^&#x([0-9a-f]{1,6});$", 1), 8, "0"))
        hexed = F.when(low.rlike(r"^&#x[0-9a-f]+;$"), hexed).when(low.rlike(r"^&#\d+;$"), F.lpad(F.hex(F.regexp_extract(low, r"^&#(\d+);$", 1).try_cast("long")), 8, "0"))
        # Surrogates and numbers beyond Unicode stay as they are.
        valid = hexed.between("00000001", "0000D7FF") | hexed.between("0000E000", "0010FFFF")
        out = F.when(valid, F.decode(F.unhex(F.when(valid, hexed)), "UTF-32"))
        for name, char in _NAMED.items():
            out = F.when(low == name, F.lit(char)).otherwise(out)
        return F.when(t.startswith("&"), F.coalesce(out, t)).otherwise(t)

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), 0), one), "")).otherwise(text)


def _dotless(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """A link's target on the page ``base`` as an address with ``://``; null where it leads to no host, as ``mailto:`` does."""
    host, path = F.regexp_extract(_rest(base), r"^([^/?#]*)", 1), path_of(base)
    own, tail = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    query = query_of(base)
    same = F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    rest = (
        F.when(own.startswith("/"), F.concat(_dotless(own), tail))
        .when(own != "", F.concat(_dotless(F.concat(folder, own)), tail))
        .when(tail.startswith("?"), F.concat(path, tail))
        .when(tail != "", F.concat(same, tail))
    )
    relative = F.when(host != "", F.concat(F.lit("x://"), host, rest))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("x:"), target)).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), relative)


def targets_of(html: Column, tag: str, attribute: str) -> Column:
    """The addresses in all such tags, decoded; an empty string for a tag without one."""
    return F.transform(F.regexp_extract_all(html, F.lit(tag), 0), lambda t: decoded(F.regexp_extract(t, attribute, 1)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): from each page's node to its canonical links and refresh targets, without loops.

    Targets are decoded and resolved against the page's url; all such tags of a page count,
    and a ``rel`` may have further words.  Null and empty pages have no links; repeated rows
    give an edge once; an empty table gives no edges.
    """
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    links = F.concat(targets_of(html, _LINK, _HREF), targets_of(html, _REFRESH, _URL))
    p = pages.select(node_of(url).alias("u"), url.alias("url"), F.explode(links).alias("t"))
    e = p.select("u", node_of(resolved(F.col("t"), F.col("url"))).alias("v"))
    return e.where("u is not null and v is not null and u <> v").distinct()


def variant_edges(pages: DataFrame) -> DataFrame:
    """(u, v): from each page's node to the same address without tracking parameters.  No redirects: a choice of the caller's."""
    e = pages.select(node_of(F.col("url")).alias("u"), plain_of(F.col("url")).alias("v"))
    return e.where("u is not null and v is not null and u <> v").distinct()


def judge(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias class and the class's verdict for every row of pages (page_id, url).

    ``edges`` (u, v) join nodes as :func:`node_of` writes them; nodes without a page may
    carry decisions too, as their own rules count.  Null urls and urls without ``://`` have
    an empty host and path, fit no rule and are allowed.  Repeated rows are judged alike;
    other columns are not read; empty tables give an empty result.  A class's decision is one
    aggregated row, and only rows whose node has an edge to another node join it.
    """
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    p = p.withColumns({"rule": name, "own": verdict})
    member = written(components(edges), "alias-classes")
    slash = F.concat(F.lit("x://"), F.col("node"))
    ruled = member.select("root", rule_of(host_of(slash), path_of(slash), rules)[1].alias("own"))
    decided = ruled.groupBy("root").agg(F.max(F.col("own") == "allow").alias("any_allow"), F.max(F.col("own") == "block").alias("any_block"))
    of_node = member.join(decided, "root").select("node", F.col("root").alias("alias"), F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block").alias("class_verdict"))
    return p.join(of_node, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "class_verdict", F.lit("allow")).alias("verdict"), F.coalesce("alias", "node").alias("alias"), "class_verdict")
