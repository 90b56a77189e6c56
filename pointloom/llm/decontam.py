"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so one Jaccard threshold fits no pair.  As in
ensembles of size partitions, documents are parted by their number of shingles into
classes (u/2, u], and each class has its own sketch, whose resolution follows u: one-
permutation MinHash, that is, every hash falls into one of B bins and each bin keeps its
least value.  For an item of q shingles of which t*q are in a document, one bin agrees
with probability p >= B/u * (1 - exp(-u/B)); B is chosen for every class and item-size
class so that all bins miss with probability under ``MISS``.  Where that takes as many bins
as the document has shingles, as for items of one or few, all its shingles are looked up.  An item is a candidate
where any bin's least value is one of its own; true word shingles then decide.

The items are in blocks of at most ``BLOCK_SHINGLES`` shingles, whose indexes executors build and save
in the shared folder.  A worker holds one at a time: it reads some documents, takes them through
all blocks, and goes on.  So documents are read once, stay where they are and are not
shuffled: no key can be hot.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import register
from .files import open_in, open_out
from .frames import id_text, map_batches, new_path, utf8, written
from .text import SHINGLE_WORDS, mix, shingle_hashes, word_hashes

CONTAINMENT = 0.8
MISS = 1e-6
BLOCK_SHINGLES = 500_000
#: Where there are several blocks, so many bytes of texts go through all of them in turn.
TURN_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _grams(words: list[bytes], k: int):
    k = min(k, len(words))
    return zip(*(words[i:] for i in range(k))) if k else iter(())


def bins_for(u: int, hits: int, miss: float = MISS) -> int:
    """Bins of the sketch for documents of up to ``u`` shingles, for items with ``hits`` shingles inside.

    With load a = u/B a given shingle is the least of its bin with probability (1-e^-a)/a.
    """
    need = 1 - miss ** (1 / max(hits, 1))
    lo, hi = 1e-6, 64.0
    for _ in range(60):
        a = (lo + hi) / 2
        lo, hi = (a, hi) if (1 - math.exp(-a)) / a > need else (lo, a)
    return max(1, math.ceil(u / lo))


@dataclass
class Index:
    """One block of items; ``classes``: by item-size class the least hits, shingle hashes (sorted) and their items."""

    threshold: float
    k: int
    ids: list[int] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    classes: dict[int, tuple[int, np.ndarray, np.ndarray]] = field(default_factory=dict)


def build(items: list[tuple[int, bytes]], threshold: float = CONTAINMENT, k: int = SHINGLE_WORDS) -> Index:
    index, parts = Index(threshold, k), defaultdict(list)
    for i, (item, text) in enumerate(items):
        words = text.lower().split()
        index.ids.append(item)
        index.words.append(words)
        h = np.unique(shingle_hashes(word_hashes(words), k))
        # Items under k words are one shingle of their own length, a class for each length.
        parts[(min(len(words), k), max(len(h), 1).bit_length())].append((i, h))
    for key, of in parts.items():
        h = np.concatenate([x for _, x in of])
        who = np.concatenate([np.full(len(x), i, np.int64) for i, x in of])
        order = np.argsort(h, kind="stable")
        index.classes[key] = (max(1, math.ceil(threshold * min(len(x) for _, x in of) - 1e-9)), h[order], who[order])
    return index


def search(index: Index, text: bytes | None) -> list[tuple[int, int, int]]:
    """(item, shared shingles, item's shingles) for items contained in the text at the threshold."""
    words = (text or b"").lower().split()
    if not words:
        return []
    wh, best, grams, sketches = word_hashes(words), {}, {}, {}
    for (k, _), (hits, keys, who) in index.classes.items():
        if len(words) < k:
            continue
        if k not in sketches:
            h = shingle_hashes(wh, k)
            v = mix(h)
            order = np.argsort(v)
            sketches[k] = h[order], v[order] >> np.uint64(32)
        h, v = sketches[k]
        n_bins = bins_for(1 << (len(h) - 1).bit_length(), hits)
        # Bins are ranges of the mixed hash, so that of sorted hashes the first in each bin is its least.
        if n_bins >= len(h):
            least = h
        else:
            bins = (v * np.uint64(n_bins)) >> np.uint64(32)
            first = np.ones(len(h), bool)
            first[1:] = bins[1:] != bins[:-1]
            least = h[first]
        at = np.searchsorted(keys, least)
        at[at == len(keys)] = 0
        found = least[keys[at] == least]
        if not len(found):
            continue
        lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        if k not in grams:
            grams[k] = set(_grams(words, k))
        for i in set(np.concatenate([who[a:b] for a, b in zip(lo, hi)]).tolist()):
            own = set(_grams(index.words[i], k))
            shared = len(own & grams[k])
            if shared >= index.threshold * len(own) - 1e-9:
                item = index.ids[i]
                best[item] = max(best.get(item, (0.0, 0, 0)), (shared / len(own), shared, len(own)))
    return [(i, n, own) for i, (_, n, own) in sorted(best.items())]


def _saved_blocks(it, folder: str, threshold: float, k: int, most: int, named: bool):
    """Indexes of rows (block, item, text) that are sorted so, one for each block, or more where it has over ``most`` shingles, as files."""
    part, size, made, now = [], 0, [], None

    def save():
        made.append((f"{folder}/{uuid.uuid4().hex}", len(part)))
        with open_out(made[-1][0]) as f:
            f.write(pickle.dumps(build(part, threshold, k)))

    for b in it:
        for block, item, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            n = len(text.split())
            if not n:
                continue
            if part and (block != now or size + n > most and not (named and part[-1][0] == item)):
                save()
                part, size = [], 0
            now = block
            part.append((item, text))
            size += n
    if part:
        save()
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["uri", "n"])


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = CONTAINMENT, k: int = SHINGLE_WORDS, most: int = BLOCK_SHINGLES, named: bool = True) -> list[str]:
    """The addresses of indexes over the items in the shared folder, each of ``most`` shingles at most (or one item).

    Executors build and save them; all texts of an item are in one block.  ``named=False``:
    over all texts, those without an id too, each as item 0.
    """
    rows = benchmark.where(f"{text_col} is not null").where(f"{id_col} is not null" if named else "true")
    rows = rows.selectExpr(f"cast({id_col} as long)" if named else "0L", f"cast({text_col} as binary)").toDF("item", "text").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, min(10_000, math.ceil(size / (6 * most))))
    # As many blocks as their size asks for, however many partitions there are.
    rows = rows.select(F.pmod(F.xxhash64("item" if named else "text"), F.lit(n)).alias("block"), "item", "text")
    dealt = rows.repartition(n, "block").sortWithinPartitions("block", "item", "text")
    folder = new_path(benchmark.sparkSession, "benchmark-index")
    files = map_batches(dealt, lambda it: _saved_blocks(it, folder, threshold, k, most, named), "uri string, n long", ("words",))
    return sorted(r.uri for r in written(files, "benchmark-blocks").collect())  # a row for each block


_HELD: dict[str, Index] = {}
register("benchmark", _HELD.clear)


def load(uri: str) -> Index:
    """A saved block; a worker holds one at a time."""
    if uri not in _HELD:
        _HELD.clear()
        with open_in(uri) as f:
            _HELD[uri] = pickle.loads(f.read())
    return _HELD[uri]


def _grouped(it, uris: list[str], at: int):
    """Batches with their texts, together as many as one turn through all blocks is worth."""
    held, size = [], 0
    for b in it:
        held.append((b, utf8(b.column(at))))
        size += b.column(at).nbytes
        if len(uris) < 2 or size >= TURN_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matches(it, uris: list[str]):
    for group in _grouped(it, uris, 1):
        rows = []
        for uri in uris:
            index = load(uri)
            rows += [(d, *m) for b, texts in group for d, t in zip(b.column(0).to_pylist(), texts) for m in search(index, t)]
        cols = [list(c) for c in zip(*rows)] or [[], [], [], []]
        cols.append([s / n for s, n in zip(cols[2], cols[3])])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()])], names=[x.split()[0] for x in SCHEMA.split(", ")])


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, k: int = SHINGLE_WORDS, most: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document row and test item of which at least ``threshold`` of the k-word shingles are in the document.

    Words are lower-cased (A-Z).  An item under k words is one shingle of its own length.
    Null or empty texts and items match nothing; items with a null id are left out; of
    several texts of one item id the best contained counts; repeated rows are judged each by
    itself; whole texts are searched, however long; other columns are not read; empty tables
    give an empty result.  The documents are read once, however many blocks the items take.
    """
    uris = blocks(benchmark, threshold=threshold, k=k, most=most)
    if not uris:
        return documents.sparkSession.createDataFrame([], SCHEMA)
    return map_batches(id_text(documents), lambda it: _matches(it, uris), SCHEMA, ("words", "benchmark"))


def _clean(it, uris: list[str], at: int):
    for group in _grouped(it, uris, at):
        keep = [[True] * len(texts) for _, texts in group]
        for uri in uris:
            index = load(uri)
            for clean, (_, texts) in zip(keep, group):
                for i, t in enumerate(texts):
                    clean[i] = clean[i] and not search(index, t)
        for clean, (b, _) in zip(keep, group):
            yield b.filter(pa.array(clean, pa.bool_()))


def keep_clean(documents: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, k: int = SHINGLE_WORDS, most: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``documents`` that contain no test item, with or without an id, with all their columns.

    Null and empty texts contain nothing and stay, as do rows without a doc_id; repeated rows
    are judged each by itself; whole texts are searched; without items all rows stay; an empty
    table gives an empty result.  The documents are read once, as in :func:`contaminated`.
    """
    at = documents.columns.index("text")
    uris = blocks(benchmark, threshold=threshold, k=k, most=most, named=False)
    if not uris:
        return documents
    return map_batches(documents, lambda it: _clean(it, uris, at), documents.schema, ("words", "benchmark"))
