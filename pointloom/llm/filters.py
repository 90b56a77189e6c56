"""Filter interaction audit: what each order of filters removes, from one scan of the texts' Arrow buffers.

The bytes of a batch's texts are scanned as they lie in the Arrow buffer.  A table gives each
byte its classes; prefix sums of the classes, read at the texts' offsets, count words, capitals,
symbols and code points of all texts at once.  Words get 64-bit hashes from a prefix sum of
weighted bytes; sorted by text and hash, equal neighbours are compared byte by byte, so that a
text's distinct words are counted exactly.  What leaves the scan is a row per text: a mask of the
filters it fails and a digest.  Copies are found by digest, masks are counted per part, and the
120 orders are evaluated on these counts, at most 32 masks a part, never on texts.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import drop_paths, map_batches, written

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
#: So many bytes are scanned at a time; the arrays of a scan take some 40 bytes for each.
PIECE = 1 << 20
#: Words up to this length are compared eight bytes at a time by all pairs at once, longer ones pair by pair.
LONG_WORD = 64

_WORD, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
_CLASS = np.full(256, _WORD | _POINT, np.uint8)
_CLASS[[32, *range(9, 14)]] = _POINT
_CLASS[range(65, 91)] |= _CAPITAL
_CLASS[[ord(c) for c in "#$%&*|"]] |= _SYMBOL
_CLASS[0x80:0xC0] &= 255 - _POINT  # bytes that continue a character

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_VALUE = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of a factor modulo 2**64, as many as asked for."""

    def __init__(self, factor: int):
        self.factor, self.held = np.uint64(factor), np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            size = max(n, PIECE + 1)
            powers = np.full(size, self.factor, np.uint64)
            powers[0] = 1
            made = np.multiply.accumulate(powers)
            if size > 2 * PIECE:
                return made  # for one very long word; not kept
            self.held = made
        return self.held[:n]


_UP, _DOWN = _Powers(_FACTOR), _Powers(_INVERSE)


def _cuts(data: np.ndarray) -> list[int]:
    """Where a run of bytes is cut into pieces: in front of white space, so that words stay whole."""
    out, n = [0], len(data)
    while n - out[-1] > PIECE:
        at, step = out[-1] + PIECE, 4096
        while at < n:
            spaces = np.flatnonzero(_CLASS[data[at : at + step]] & _WORD == 0)
            if len(spaces):
                at += int(spaces[0])
                break
            at, step = at + step, 2 * step
        if at >= n:
            break
        out.append(at)
    return [*out, n]


def _scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts side by side: (word, capital, symbol, code point) counts as columns, and the words' starts, ends and hashes."""
    classes = _CLASS[data]
    word = (classes & _WORD).astype(bool)
    before = np.concatenate([[False], word[:-1]])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False  # a text begins anew
    first = word & ~before
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~(word[1:] & ~first[1:])
    ends = np.flatnonzero(last) + 1
    counts = np.empty((len(offsets) - 1, 4), np.int64)
    counts[:, 0] = np.diff(np.searchsorted(starts, offsets))
    for i, bit in ((1, _CAPITAL), (2, _SYMBOL), (3, _POINT)):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum((classes & bit) != 0, out=sums[1:])
        counts[:, i] = np.diff(sums[offsets])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _UP(len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _DOWN(len(data) + 1)[starts]
    return counts, starts, ends, _spread(hashes)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; ``data`` has eight bytes more at its end."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


_KEEP = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words at ``a`` and ``b``, each of ``size`` bytes, are the same; ``data`` is padded."""
    same, views = np.ones(len(a), bool), _eight(data)
    todo = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        keep = _KEEP[np.minimum(size[todo] - at, 8)]
        same[todo] &= (views[a[todo] + at] & keep) == (views[b[todo] + at] & keep)
        todo = todo[(size[todo] > at + 8) & same[todo]]
        if not len(todo):
            break
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        n = int(size[i])
        same[i] = np.array_equal(data[a[i] : a[i] + n], data[b[i] : b[i] + n])
    return same


def _distinct(data: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """The number of distinct words of each text, of up to 256 texts; ``data`` is padded."""
    key = (text.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
    order = np.argsort(key)
    key, at, size = key[order], starts[order], (ends - starts)[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    same = (size[again] == size[again + 1]).copy()
    close = again[same]
    same[same] = _equal(data, at[close], at[close + 1], size[close])
    fresh = np.ones(len(key), bool)
    fresh[again + 1] = ~same
    out = np.bincount(text[order][fresh], minlength=n_texts)
    if not same.all():  # different words of one hash: their run is counted by its words
        run = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        for r in np.unique(run[again[~same]]).tolist():
            lo, hi = np.searchsorted(run, [r, r + 1])
            words = {data[a : a + n].tobytes() for a, n in zip(at[lo:hi].tolist(), size[lo:hi].tolist())}
            out[text[order[lo]]] += len(words) - int(fresh[lo:hi].sum())
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(words, distinct words, capitals, symbols, code points) of up to 256 texts that lie side by side in ``data``.

    ``offsets`` has one entry more than there are texts, from 0 to the length of ``data``.
    """
    n = len(offsets) - 1
    out = np.zeros((n, 5), np.int64)
    if not len(data):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    cuts = _cuts(data) if n == 1 else [0, len(data)]
    parts = []
    for lo, hi in zip(cuts, cuts[1:]):
        counts, starts, ends, hashes = _scan(data[lo:hi], np.array([0, hi - lo]) if n == 1 else offsets)
        out[:, [0, 2, 3, 4]] += counts
        parts.append((starts + lo, ends + lo, hashes))
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts))
    out[:, 1] = _distinct(padded, np.repeat(np.arange(n), out[:, 0]), starts, ends, hashes, n)
    return out


def masks(counts: np.ndarray) -> np.ndarray:
    """The filters A to D that each row of :func:`statistics` fails, as bits from A = 1 on."""
    words, distinct, capitals, symbols, points = counts.T
    fails = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITAL_PERCENT * points, symbols > 0)
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its texts' offsets in them, from 0 on; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    n, wide = len(column), pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _masks(it):
    for b in it:
        if not b.num_rows:
            continue
        data, offsets = _buffers(b.column(2))
        found = np.empty(b.num_rows, np.int64)
        lo = 0
        while lo < b.num_rows:  # as many texts as a piece holds, or one
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
            at, end = int(offsets[lo]), int(offsets[hi])
            found[lo:hi] = masks(statistics(data[at:end], offsets[lo : hi + 1] - at))
            lo = hi
        ends = offsets.tolist()
        digests = [hashlib.sha256(data[i:j]).digest() for i, j in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.astype(np.int32)), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def scan(documents: DataFrame, part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (bits of A to D) and the text's SHA-256 for every row of documents.

    A null text is empty and a null part the empty string; other columns are not read.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.col("text").cast("string").alias("text")), _masks, "doc_id long, part string, mask int, digest binary")


def mask_counts(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (with E), good, toxic, n: how many documents of a part fail just these filters.

    E is failed by a document with the text of one with a smaller doc_id, in any part.  A
    document is good (toxic) if a row of ``labels`` says so.  Rows are first counted by
    (text, doc_id), then by (text, part, labels) with the least doc_id of each, so a text
    that a third of all rows share is a few rows for each task and for the window.
    """
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = scanned.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("k")).join(flags, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    of_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("k")).otherwise(0)).alias("no_id"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k"))).alias("least"))
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    of_text = of_text.withColumn("stay", F.col("no_id") + F.when(F.col("least.doc_id") == least, F.col("least.k")).otherwise(0))
    either = F.array(F.struct(F.col("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    return of_text.select("part", "good", "toxic", F.inline(either)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n > 0")


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) of all orders."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append((order, step, bit, before))
            before |= bit
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, zeros included, from :func:`mask_counts`.

    A filter behind a set of others removes the same documents in whatever order these
    stood; so the counts are taken for each of the 80 such settings of a part, and the 600 steps
    look them up.
    """
    settings = sorted({s[2:] for s in _steps()})
    each = F.explode(F.array(*(F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before")) for bit, before in settings))).alias("s")
    c = counts.select("part", "mask", "good", "toxic", "n", each).select("part", "mask", "good", "toxic", "n", "s.*")
    mask, bit, before = (F.col(x) for x in ("mask", "bit", "before"))
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    number = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    at = c.groupBy("part", "bit", "before").agg(
        number(~fails & ~gone).alias("kept"), number(fails & ~gone).alias("removed"), number(fails & gone).alias("redundant"), number(mask == bit).alias("unique_fails"),
        number(fails & ~gone & F.col("good")).alias("good_lost"), number(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    steps: dict[int, list[str]] = {}
    for order, step, b, f in _steps():
        steps.setdefault(32 * b + f, []).append(f"struct('{order}' as filter_order, {step} as step)")
    of = F.expr(f"map({', '.join(f'{k}, array({", ".join(v)})' for k, v in steps.items())})")
    numbers = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    shapley = at.select("part", "bit", (F.col("removed") * F.size(of[32 * bit + before])).alias("r")).groupBy("part", "bit").agg(F.sum("r").alias("shapley"))
    return at.join(shapley, ["part", "bit"]).select("part", *numbers, "shapley", F.inline(of[32 * bit + before])).select("part", "filter_order", "step", *numbers, "shapley")


def audit(documents: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters fail a document: A under 100 words; B fewer than 80 distinct words in 100; C more
    than 10 capitals A-Z in 100 code points; D any of ``#$%&*|``; E the text of a smaller
    doc_id.  Words are runs of bytes other than the six ASCII white space characters, told
    apart by case.  Null texts are empty (and copies of each other), null parts the empty
    string.  Rows without a doc_id are counted, fail no E and make none fail; repeated rows
    count each by itself, and equal rows are not copies of each other, as neither doc_id is smaller;
    whole texts are scanned however long; an empty table gives an empty result.
    """
    spark, scratch = documents.sparkSession, []
    scanned = written(scan(documents, part_col), "filter-masks", scratch)
    counts = written(mask_counts(scanned, labels), "mask-counts")
    drop_paths(spark, scratch)
    return interactions(counts)
