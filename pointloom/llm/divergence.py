"""Source divergence audit by joint count histograms.

Terms are counted per (language, source) group within each task, so a source with a third of all
texts is a row per term and task like any other.  For two sources of a language only the pair of
counts of a term matters; so terms are tallied by distinct (count, count) pairs and the divergence's
term f is evaluated once for each pair and multiplied.  Cells with a zero are never listed term
by term: they follow from the sources' own count histograms and the number of kept terms, less
what the joint cells hold.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import drop_paths, map_batches, utf8, written

MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: A task sends its counts on when it holds so many, some 60 MB.
HELD = 300_000
#: Texts are searched for terms in pieces of about so many bytes.
PIECE = 1 << 20
OUT_ROWS = 50_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")
_CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _pieces(text: bytes):
    """A text in pieces of about ``PIECE`` bytes that cut no term."""
    at = 0
    while len(text) - at > PIECE:
        cut = _OTHER.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def _sent(held: dict[tuple[str, str], tuple[Counter, Counter]]):
    for (lang, source), (n, docs) in held.items():
        terms = list(n)
        for at in range(0, len(terms), OUT_ROWS):
            some = terms[at : at + OUT_ROWS]
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), pa.array(some, pa.binary()), pa.array(map(n.__getitem__, some), pa.int64(), size=k), pa.array(map(docs.__getitem__, some), pa.int64(), size=k)], schema=_CELLS)


def _cells(it):
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for b in it:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
            if not text:
                continue
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for piece in _pieces(text.lower()):
                terms = _TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size >= HELD:
                yield from _sent(held)
                held, size = {}, 0
    yield from _sent(held)


def _p(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)) in whole numbers, for counts up to 19 digits."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0)) div cast(nullif({total} + {kept}, 0) as decimal(20,0))")


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square is a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def groups_of(documents: DataFrame) -> DataFrame:
    """lang, source, text with null as the empty string, whatever else the table has."""
    return documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, total, sources: the terms in at least so many documents of a language, with their counts by source.

    ``sources`` is an array of (source, n), n > 0, in order; it is as long as a language has sources at
    most.  All counts of a term meet by (lang, term): a row for each source and task.
    """
    cells = map_batches(groups_of(documents), _cells, "lang string, source string, term binary, n long, docs long")
    cells = cells.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"))
    return terms.where(F.col("docs") >= min_documents).select("lang", F.col("term").cast("string").alias("term"), "total", "sources")


def _statistics(documents: DataFrame, kept: DataFrame, histogram: DataFrame) -> DataFrame:
    """lang, source, total, kept, lang_total for every occurring group: its counts' sum, the language's number of kept terms and their counts' sum."""
    sums = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    out = groups_of(documents).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return out.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")))


def joint_counts(kept: DataFrame, histogram: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, x, y, terms: how many kept terms have x occurrences in source a and y in b, for a < b, zeros included.

    Terms in both sources are tallied as they are.  Of each, one is taken from the cells (x, 0) and
    (0, y), which begin as the sources' own histograms, and given back to (0, 0), which begins
    as the number of kept terms less both sources' own.
    """
    one = kept.select("lang", "sources", F.posexplode("sources").alias("i", "one"))
    two = one.select("lang", F.col("one.source").alias("a"), F.col("one.n").alias("x"), F.inline(F.slice("sources", F.col("i") + 2, F.size("sources"))).alias("b", "y"))
    both = two.groupBy("lang", "a", "b", "x", "y").agg(F.count("*").alias("terms"))
    cell = lambda x, y, terms: F.struct(x.alias("x"), y.alias("y"), terms.alias("terms"))
    x, y, terms, zero = F.col("x"), F.col("y"), F.col("terms"), F.lit(0).cast("long")
    both = both.select("lang", "a", "b", F.inline(F.array(cell(x, y, terms), cell(x, zero, -terms), cell(zero, y, -terms), cell(zero, zero, terms))))
    n = F.col("n")
    alone = [
        pairs.join(histogram.withColumnRenamed("source", side), ["lang", side]).select("lang", "a", "b", F.inline(F.array(cell(*at, terms), cell(zero, zero, -terms))))
        for side, at in (("a", (n, zero)), ("b", (zero, n)))
    ]
    none = pairs.select("lang", "a", "b", zero.alias("x"), zero.alias("y"), F.col("kept").alias("terms"))
    rows = both.unionByName(alone[0]).unionByName(alone[1]).unionByName(none)
    return rows.groupBy("lang", "a", "b", "x", "y").agg(F.sum("terms").alias("terms")).where("terms > 0")


def divergences(joint: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, source, item, value: both directions of each pair, f once for each distinct pair of counts."""
    j = joint.join(pairs, ["lang", "a", "b"]).withColumns({"p": _p("x", "total_a", "kept"), "q": _p("y", "total_b", "kept")})
    times = lambda f: F.sum(f.cast("decimal(20,0)") * F.col("terms")).cast("long")
    sums = j.groupBy("lang", "a", "b").agg(times(_f("p", "q")).alias("ab"), times(_f("q", "p")).alias("ba"))
    both = pairs.join(sums, ["lang", "a", "b"], "left")
    row = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.coalesce(v, F.lit(0).cast("long")).alias("value"))
    return both.select("lang", F.inline(F.array(row("a", "b", "ab"), row("b", "a", "ba"))))


def excesses(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: f of each term that a group has more often than its language."""
    rows = kept.select("lang", "term", F.col("total").alias("count"), F.inline("sources")).join(groups, ["lang", "source"])
    rows = rows.withColumns({"p": _p("n", "total", "kept"), "q": _p("count", "lang_total", "kept")}).where("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others (part ``pair``) and by which terms from its language (``term``).

    Terms are runs of A-Z, a-z and characters beyond ASCII, with A-Z lower-cased; those in at
    least ``min_documents`` rows of a language are kept.  Ranks go by falling value, then by
    item; the report of terms ends at rank ``top``.  Null lang, source and text are the empty
    string; groups without terms are compared too, and where a language keeps no term all
    values are 0.  Repeated rows are documents of their own; whole texts are read, however long;
    other columns are not read; an empty table gives an empty result.  All arithmetic is
    in whole numbers.
    """
    spark, scratch = documents.sparkSession, []
    kept = written(kept_terms(documents, min_documents), "kept-terms")
    histogram = written(kept.select("lang", F.inline("sources")).groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "count-histograms", scratch)
    groups = written(_statistics(documents, kept, histogram), "source-groups")
    of = lambda side: groups.select("lang", F.col("source").alias(side), F.col("total").alias(f"total_{side}"), *(["kept"] if side == "a" else []))
    pairs = written(of("a").join(of("b"), "lang").where("a < b"), "source-pairs", scratch)  # as many rows as the report has pairs
    joint = written(joint_counts(kept, histogram, pairs), "joint-counts", scratch)
    apart = written(divergences(joint, pairs), "source-divergences")
    drop_paths(spark, scratch)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    # The least ranks are taken within each task before rows meet by group.
    return ranked(apart, "pair").unionByName(ranked(excesses(kept, groups), "term").where(F.col("rank") <= top))
