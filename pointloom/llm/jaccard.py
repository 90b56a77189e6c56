"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles.  Equal sets are one class with one representative, so
copies cost one aggregated row.  Representatives carry a MinHash sketch of ``POSITIONS``
tokens (position, least value).  A run starts with all of them in one bucket; a bucket with
more than ``LIMIT`` members is split: each (bucket, token) pair is chosen by a hash with
probability 1/(threshold * POSITIONS), and a member goes to the child of each of its chosen
tokens, so members at the threshold meet in one child on average.  Buckets are split, at any
depth, until they are small or their members' similarity is ``ALIKE`` on average, as counted
in ``PROBES`` positions of their sketches: such a bucket would not shrink, and is a group of
near copies, most of whose pairs are links.  These are the leaves.  Buckets of up to ``LOCAL``
members are split to the end in a task each, larger ones one level at a time by all.  Runs are repeated until a
pair at the threshold meets in a leaf with probability ``RECALL`` at the depth of the leaves
(see :func:`runs_for`): runs for depth two over all, and where buckets were split deeper,
further runs over the members of these, since only their pairs can have been parted there.

Leaves are searched by brute force, first on one-byte sketches, then, for what remains, on
the exact shingle sets.  A pair that meets in several leaves belongs to the largest of them
only, so that most pairs of a group are verified in one place.  Leaves above ``CHUNK`` members are searched as pairs of chunks, each in a task of its
own.  What leaves a task is one row per member (its links, and one edge towards its block's
component), never the pairs; so a group of near copies grows by its members.  Sets are
nodes by their digest, so rows of one doc_id with different texts stay apart.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import drop_paths, id_text, map_batches, utf8, written
from .text import SHINGLE_WORDS, mix, seeds, shingle_set

THRESHOLD = 0.8
POSITIONS = 128
LIMIT = 512
LOCAL = 8192
ALIKE = 0.5
PROBES = 16
RECALL = 0.9999
CHUNK = 512
CHUNK_BYTES = 8 << 20
#: Up to so many sets with candidates, some 20 MB, are sent to the texts; if there are more, the texts are shuffled.
SENT_ROWS = 200_000
#: Sketches whose share of equal bytes is lower by this are not looked at again: over five standard deviations.
SLACK = 0.18


def survival(depth: int) -> float:
    """The probability that a pair at the threshold still shares a bucket after ``depth`` splits (children per bucket: Poisson, mean 1)."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_for(recall: float = RECALL, depth: int = 1) -> int:
    """The runs that a pair at the threshold needs when leaves are ``depth`` splits deep."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


_MULT = seeds(POSITIONS, salt=17)


def sketch(s: np.ndarray) -> np.ndarray:
    """The upper halves of the least products of a set's hashes with fixed multipliers."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        low = np.minimum(low, np.multiply.outer(_MULT, s[at : at + 512]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


_PLACE = mix(np.arange(POSITIONS, dtype=np.uint64) + np.uint64(1) << np.uint64(33))


def _below(h: np.ndarray) -> np.ndarray:
    """The names of buckets below others.  All 64 bits are hash, from the run's root on, so runs of any number stay apart."""
    return mix(h).view(np.int64)


def roots(first: int, runs: int) -> np.ndarray:
    """The buckets that the runs from ``first`` on begin with."""
    return _below(np.arange(first + 1, runs + 1, dtype=np.uint64))


def _chosen(h: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(h < np.uint64(int(2**64 / (threshold * POSITIONS))))


def children(nodes: np.ndarray, values: np.ndarray, threshold: float) -> np.ndarray:
    """The buckets below ``nodes`` that a sketch goes to."""
    h = mix((values.astype(np.uint64) ^ _PLACE)[None, :] + mix(nodes)[:, None])
    return _below(h[_chosen(h, threshold)])


def children_of(node: int, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`children`, for many sketches in one bucket: (member, child)."""
    h = mix((sketches.astype(np.uint64) ^ _PLACE[None, :]) + mix(np.array([node], np.int64)))
    member, position = _chosen(h, threshold)
    return member, _below(h[member, position])


_BASE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.binary()), ("size", pa.int64()), ("sketch", pa.binary())])


def _base(it, k: int):
    for b in it:
        rows = []
        for doc, text, h in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()):
            s = shingle_set(text, k)
            rows.append((doc, h, xxhash.xxh3_128_digest(s.tobytes()), len(s), sketch(s).tobytes()) if len(s) and doc is not None else (doc, h, None, 0, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BASE.types)], schema=_BASE) if rows else pa.RecordBatch.from_pylist([], _BASE)


def _split(it, threshold: float, first: int = 0, runs: int = 0):
    """Children of (fp, size, sketch[, node]); without a node, of the roots of the runs from ``first`` on."""
    top = roots(first, runs)
    for b in it:
        fps, nodes, sizes = [], [], []
        given = b.column(3).to_numpy() if b.num_columns > 3 else None
        for i, (fp, size, sk) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
            c = np.unique(children(top if given is None else given[i : i + 1], np.frombuffer(sk, "<u4"), threshold))
            nodes.append(c)
            fps += [fp] * len(c)
            sizes += [size] * len(c)
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.concatenate(nodes) if nodes else [], pa.int64())], names=["fp", "size", "node"])


def _alike(sk: np.ndarray) -> float:
    """The mean similarity of all pairs of sketches, each with itself included, from squared counts of equal values."""
    squares = sum(int((np.unique(sk[:, p], return_counts=True)[1].astype(np.int64) ** 2).sum()) for p in range(0, POSITIONS, POSITIONS // PROBES))
    return squares / (PROBES * len(sk) ** 2)


_LEAF = pa.schema([("fp", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("depth", pa.int64())])
_LEAF_SQL = "fp binary, node long, n long, total long, depth long"


def _descend(it, threshold: float, limit: int, level: int):
    """The leaves below whole buckets (node, fp, size, sketch), sorted by node, and (fp) without a node for members of those split below the first level."""
    for (root,), t in _groups(it, 1):
        fps, sizes = t.column("fp").to_pylist(), t.column("size").to_numpy()
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u4").reshape(-1, POSITIONS)
        todo, deep = [(root, np.arange(len(fps)), level)], np.zeros(len(fps), bool)
        while todo:
            node, at, depth = todo.pop()
            if len(at) <= limit or _alike(sk[at]) >= ALIKE:
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([fps[i] for i in at.tolist()], pa.binary()), *(pa.array([x] * n, pa.int64()) for x in (node, n, int(sizes[at].sum()), depth))], schema=_LEAF)
                continue
            deep[at] |= depth > 1
            member, child = children_of(node, sk[at], threshold)
            order = np.lexsort((member, child))
            member, child = member[order], child[order]
            cuts = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1], [True]])) if len(child) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1 and len(below := np.unique(member[lo:hi])) > 1:
                    todo.append((int(child[lo]), at[below], depth + 1))
        if deep.any():
            marked = [fps[i] for i in np.flatnonzero(deep).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(marked, pa.binary()), *(pa.nulls(len(marked), pa.int64()) for _ in range(4))], schema=_LEAF)


def _groups(it, n_keys: int):
    """Tables of rows with equal keys from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in it:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(keys[lo].tolist())
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


_CANDIDATES = pa.schema([("node", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("fp", pa.binary()), ("partners", pa.list_(pa.binary()))])


def _meet(lists: list[list[int]]) -> np.ndarray:
    """Which pairs of lists have a leaf in common, as a matrix; built for 4,096 leaves at a time."""
    flat = np.array([x for xs in lists for x in xs], np.int64)
    who = np.repeat(np.arange(len(lists)), [len(xs) for xs in lists])
    _, leaf, often = np.unique(flat, return_inverse=True, return_counts=True)
    who, leaf = who[often[leaf] > 1], leaf[often[leaf] > 1]
    order = np.argsort(leaf, kind="stable")
    who, leaf = who[order], leaf[order]
    out = np.zeros((len(lists), len(lists)), bool)
    for lo in range(0, len(often), 4096):
        i, j = np.searchsorted(leaf, [lo, lo + 4096])
        if i < j:
            m = np.zeros((len(lists), 4096), np.float32)
            m[who[i:j], leaf[i:j] - lo] = 1
            out |= m @ m.T > 0
    return out


def _owned(node: int, sk: np.ndarray, side: np.ndarray, across: bool, lists: list, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in a block that look alike and meet in no leaf that comes before ``node`` in both members' lists."""
    need, first, second = math.ceil(least * POSITIONS), [], []
    for a in range(len(sk) - 1):
        like = np.flatnonzero((sk[a + 1 :] == sk[a]).sum(axis=1) >= need) + a + 1
        if across:
            like = like[side[like] != side[a]]
        if len(like):
            first.append(np.full(len(like), a))
            second.append(like)
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(first), np.concatenate(second)
    before = {i: lists[i][: lists[i].index(node)] for i in {*a.tolist(), *b.tolist()}}
    if len(a) <= 4 * len(sk):
        sets = {i: set(xs) for i, xs in before.items()}
        keep = np.array([sets[i].isdisjoint(sets[j]) for i, j in zip(a.tolist(), b.tolist())], bool)
    else:
        keep = ~_meet([before.get(i, []) for i in range(len(sk))])[a, b]
    return a[keep], b[keep]


def _search(it, least: float):
    for key, t in _groups(it, 3):
        node, i, j = key
        if t.num_rows < 2:
            continue
        sk = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(-1, POSITIONS)
        a, b = _owned(node, sk, t.column("side").to_numpy(), i != j, t.column("nodes").to_pylist(), least)
        if not len(a):
            continue
        fps = t.column("fp").to_pylist()
        rows = np.union1d(a, b)
        # Pairs are in order of their first member; members that are a second one only have no partners of their own.
        ends = np.searchsorted(a, rows, "right")
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(offsets), pa.array([fps[x] for x in b.tolist()], pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(rows), pa.int64()) for x in key] + [pa.array([fps[r] for r in rows.tolist()], pa.binary()), partners], schema=_CANDIDATES)


_SETS = pa.schema([("fp", pa.binary()), ("rep", pa.int64()), ("copies", pa.int64()), ("items", pa.binary())])


def _sets(it, k: int):
    for b in it:
        rows = []
        for want, rep, copies, text in zip(*(b.column(i).to_pylist() for i in range(3)), utf8(b.column(3))):
            s = shingle_set(text, k)
            if xxhash.xxh3_128_digest(s.tobytes()) == want:
                rows.append({"fp": want, "rep": rep, "copies": copies, "items": s.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, _SETS)


def _shared(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of given pairs of sorted sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    by_pair = float(sizes[pairs].sum()) * 12 + 8000 * len(pairs)
    flat = np.concatenate(sets)
    by_product = 150.0 * len(flat) + 0.1 * n * n * len(flat) / 4
    if by_pair <= by_product:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs])
    _, where, df = np.unique(flat, return_inverse=True, return_counts=True)
    often = np.flatnonzero(df > 1)
    column = np.full(len(df), -1, np.int64)
    column[often] = np.arange(len(often))
    rows, cols = np.repeat(np.arange(n), sizes), column[where]
    rows, cols = rows[cols >= 0], cols[cols >= 0]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for lo in range(0, len(often), 8192):
        a, b = np.searchsorted(cols, [lo, lo + 8192])
        m = np.zeros((n, min(8192, len(often) - lo)), np.float32)
        m[rows[a:b], cols[a:b] - lo] = 1
        out += m @ m.T
    return out[pairs[:, 0], pairs[:, 1]].astype(np.int64)


_LINKS = pa.schema([("fp", pa.binary()), ("rep", pa.int64()), ("links", pa.int64()), ("top", pa.binary())])


def _verify(it, threshold: float):
    """Of each block's candidates the links of every member, and its edge to the least member it is joined to there."""
    for _, t in _groups(it, 3):
        fps = t.column("fp").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        at = {fp: i for i, fp in enumerate(fps)}
        partners = t.column("partners").combine_chunks()
        n_of = partners.value_lengths().to_numpy(zero_copy_only=False)
        second = np.fromiter((at.get(p, -1) for p in partners.flatten().to_pylist()), np.int64, int(n_of.sum()))
        pairs = np.stack([np.repeat(np.arange(len(fps)), n_of), second], axis=1)[second >= 0]
        if not len(pairs):
            continue
        sizes, copies = np.array([len(s) for s in sets]), t.column("copies").to_numpy()
        ids = t.column("rep").to_pylist()
        both = _shared(sets, pairs)
        # both / union >= threshold, in whole numbers up to the last division
        pairs = pairs[both >= threshold * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - both) - 1e-9]
        links, up = np.zeros(len(fps), np.int64), list(range(len(fps)))

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
        for a, b in zip(pairs[:, 0].tolist(), pairs[:, 1].tolist()):
            x, y = top(a), top(b)
            if x != y:
                x, y = (x, y) if fps[x] <= fps[y] else (y, x)
                up[y] = x
        rows = np.flatnonzero(links).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([fps[r] for r in rows], pa.binary()), pa.array([ids[r] for r in rows], pa.int64()), pa.array(links[rows], pa.int64()), pa.array([fps[top(r)] for r in rows], pa.binary())], schema=_LINKS)


def _likeness(it):
    for (node, _), t in _groups(it, 2):
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u4").reshape(-1, POSITIONS)
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([len(sk)]), pa.array([_alike(sk) * len(sk)])], names=["node", "m", "s"])


def _similarity(members: DataFrame) -> DataFrame:
    """(node, alike): the mean similarity of a bucket's members (node, n, fp, sketch), within parts of about ``LOCAL`` by hash that hold all of them."""
    part = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / LOCAL)).alias("part")
    d = members.select("node", part, "sketch").repartition("node", "part").sortWithinPartitions("node", "part")
    return map_batches(d, _likeness, "node long, m long, s double").groupBy("node").agg((F.sum("s") / F.sum("m")).alias("alike"))


def _leaves(reps: DataFrame, threshold: float, first: int, runs: int, limit: int, scratch: list[str]) -> tuple[DataFrame, int, DataFrame | None]:
    """(fp, node, n, total), the leaves of some runs that two or more representatives share, with their members and summed set sizes.

    And the depth of the deepest, and (fp) of members of buckets below the first level that were split.
    """
    spark, names = reps.sparkSession, ["fp", "node", "n", "total"]
    rows = map_batches(reps.select("fp", "size", "sketch"), lambda it: _split(it, threshold, first, runs), "fp binary, size long, node long")
    leaves, deep, level, depth, once = None, None, 0, 0, []
    rows = written(rows, "paths", once)
    while True:
        level += 1
        # Tables of their own, so that joins are of two plain sides and can be split at a bucket with very many members.
        met = written(rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1"), "met", once)
        met = written(rows.select("fp", "node").join(met, "node"), "buckets", scratch)
        drop_paths(spark, once)
        small, large = met.where(F.col("n") <= limit).select(names), met.where(F.col("n") > limit)
        leaves, depth = small if leaves is None else leaves.unionByName(small), max(depth, level)
        most = large.agg(F.max("n")).first()[0]
        if most is None:
            break
        members = written(large.join(reps.select("fp", "size", "sketch"), "fp"), "large-buckets", once)
        whole = members.where(F.col("n") <= LOCAL).select("node", "fp", "size", "sketch").repartition("node").sortWithinPartitions("node")
        below = written(map_batches(whole, lambda it, at=level: _descend(it, threshold, limit, at), _LEAF_SQL), "leaves", scratch)
        leaves, depth = leaves.unionByName(below.where("node is not null").select(names)), max(depth, below.agg(F.max("depth")).first()[0] or 0)
        marked = below.where("node is null").select("fp")
        deep = marked if deep is None else deep.unionByName(marked)
        if most <= LOCAL:
            drop_paths(spark, once)
            break
        members = written(members.where(F.col("n") > LOCAL), "huge-buckets", scratch)
        drop_paths(spark, once)
        alike = written(_similarity(members), "similarities", scratch)
        leaves = leaves.unionByName(members.join(alike.where(F.col("alike") >= ALIKE), "node").select(names))
        apart = members.join(alike.where(F.col("alike") < ALIKE), "node").select("fp", "size", "sketch", "node")
        if level > 1:
            deep = deep.unionByName(apart.select("fp"))
        # Dealt anew, so that a bucket with very many members is split by all.
        rows = map_batches(apart.repartition("fp", "node"), lambda it: _split(it, threshold), "fp binary, size long, node long")
    return leaves, depth, None if deep is None or deep.isEmpty() else deep


def _blocks(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """One row per member and block: (node, i, j, side, fp, bytes, nodes), its leaves from the largest on."""
    lists = leaves.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "node", "n", "total"))).alias("at"))
    m = lists.join(reps, "fp").select("fp", "bytes", F.transform("at", lambda x: x["node"]).alias("nodes"), F.explode("at").alias("x"))
    m = m.select("fp", "bytes", "nodes", "x.*")
    c = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(8 * F.col("total") / CHUNK_BYTES))
    own = F.pmod(F.xxhash64("fp", "node"), c)
    m = m.withColumns({"c": c, "own": own})
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("o")
    m = m.select("*", other)
    return m.select("node", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("long").alias("side"), "fp", "bytes", "nodes")


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def join(documents: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE_WORDS, recall: float = RECALL, limit: int = LIMIT, hashes: bool = False) -> DataFrame:
    """doc_id, class_id, n_links for every row of documents; with ``hashes``, also text_hash and component, for :func:`keep_one`.

    Words are lower-cased (A-Z); a text under k words is one shingle.  Rows are linked where
    the Jaccard similarity of their shingle sets is at least ``threshold``; ``n_links`` counts
    the other rows, copies included; ``class_id`` is the least doc_id of the row's connected
    component.  Null, empty and white texts, and rows without a doc_id, have no link and are
    their own class.  Repeated rows are copies of each other; rows of one doc_id with
    different texts are judged each by itself.  Whole texts count, however long.  Ties do not
    arise.  Other columns are not read; an empty table gives an empty result.
    """
    spark, scratch = documents.sparkSession, []
    docs = id_text(documents)
    base = written(map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), lambda it: _base(it, k), "doc_id long, text_hash long, fp binary, size long, sketch binary", ("words",)), "sketches")
    least_byte = F.expr(f"transform(sequence(0, {POSITIONS - 1}), x -> substring(sketch, 4 * x + 1, 1))")
    reps = base.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("sketch").alias("sketch"))
    reps = written(reps, "representatives", scratch)
    with_bytes = reps.select("fp", F.unhex(F.array_join(F.transform(least_byte, lambda x: F.hex(x)), "")).alias("bytes"))
    leaves, left, done, need = None, reps, 0, runs_for(recall, 2)
    while left is not None and done < need:
        more, depth, deep = _leaves(left, threshold, done, need, limit, scratch)
        leaves = more if leaves is None else leaves.unionByName(more)
        done, need = need, max(need, runs_for(recall, depth))
        left = None if deep is None else written(reps.join(deep.distinct(), "fp", "left_semi"), "deep", scratch)
    found = written(map_batches(_dealt(_blocks(leaves, with_bytes)), lambda it: _search(it, threshold - SLACK), "node long, i long, j long, fp binary, partners array<binary>"), "candidates", scratch)
    wanted = reps.select("fp", F.col("rep").alias("doc_id"), "copies").join(found.select("fp").distinct(), "fp", "left_semi")
    wanted = written(wanted, "wanted", scratch)
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted
    texts = docs.join(wanted, "doc_id").select("fp", "doc_id", "copies", "text")
    # Rows that repeat a doc_id and its text give a set twice; dealt by fp it is needed anyway for what follows.
    sets = map_batches(texts, lambda it: _sets(it, k), "fp binary, rep long, copies long, items binary", ("words",)).dropDuplicates(["fp"])
    full = found.join(sets, "fp").select("node", "i", "j", "fp", "rep", "copies", "items", "partners")
    links = written(map_batches(_dealt(full), lambda it: _verify(it, threshold), "fp binary, rep long, links long, top binary"), "links", scratch)
    tops = components(links.select(F.col("fp").alias("u"), F.col("top").alias("v")).distinct())
    linked = links.groupBy("fp").agg(F.sum("links").alias("links"), F.min("rep").alias("rep")).join(tops.withColumnRenamed("node", "fp"), "fp")
    linked = written(linked, "linked", scratch)
    # Tables of their own, so that joins are of two plain sides and can be split at a class with very many members or copies.
    named = written(linked.groupBy("root").agg(F.min("rep").alias("class_id")), "class-names", scratch)
    of_set = linked.join(named, "root").select("fp", "root", "class_id", "links")
    of_set = reps.join(of_set, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_set = written(of_set, "classes")
    drop_paths(spark, scratch)
    # Rows without a set have keys of their own, so that they are dealt evenly.
    key = F.coalesce("fp", F.encode(F.concat(F.lit("-"), F.xxhash64("doc_id", "text_hash").cast("string")), "UTF-8"))
    out = base.select("doc_id", "text_hash", key.alias("fp")).join(of_set, "fp", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_hash", F.coalesce("component", "fp").alias("component"))
    return out if hashes else out.drop("text_hash", "component")


def keep_one(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class of ``join(documents, hashes=True)``: a row whose doc_id is the class id, with all its columns.

    Rows of one doc_id with different texts are told apart: those in different classes stay,
    of those in one class the text with the least hash.  Null, empty and white texts are
    classes of their own.  Of rows with equal doc_id and text one stays, but all rows without
    a doc_id.  Columns are those of ``documents``; an empty table gives an empty result.
    """
    of_text = classes.where("doc_id = class_id").groupBy("class_id", "component", "text_hash").agg(F.count("*").alias("n"))
    least = of_text.groupBy("class_id", "component").agg(F.min(F.struct(F.col("text_hash").alias("h"), F.col("n"))).alias("x"))
    least = written(least.groupBy("class_id", "x.h").agg(F.max("x.n").alias("n")), "kept-texts")
    is_kept = lambda of: (documents["doc_id"].cast("long") == of["class_id"]) & (F.xxhash64(documents["text"]) == of["h"])
    once, often = least.where("n = 1"), least.where("n > 1")
    kept = documents.join(once, is_kept(once), "left_semi").unionByName(documents.where("doc_id is null"))
    if often.isEmpty():
        return kept
    # Only rows that are repeated meet, and are reduced within each task before.  Their key is a struct of a name that no column has.
    key = f"key-{uuid.uuid4().hex}"
    again = documents.join(often, is_kept(often), "left_semi").withColumn(key, F.struct(documents["doc_id"].cast("long"), F.xxhash64(documents["text"])))
    return kept.unionByName(again.dropDuplicates([key]).drop(key))
