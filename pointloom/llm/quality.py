"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Two multinomials over ``BUCKETS`` hashed features (runs of word characters, runs of
other visible characters, and pairs of both) are counted: one over every document,
one over trusted documents.  A document's score is the mean over its features of
log p_target - log p_raw, so length does not matter, and every document is judged by
one threshold: no sampling.  Base rules on words, symbols and repetition come first.

Bounds: the target is fitted on at most ``max_trusted`` labelled rows (the least by
hash of doc_id, half of them for the threshold); raw counts take in every document.
The driver holds 2 x BUCKETS counts and the scores of those labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import register
from .frames import id_text, map_batches, utf8

BUCKETS = 1 << 16
MAX_TRUSTED = 16_384
SMOOTHING = 1.0
#: Of this many features on average, spread as in the raw corpus, the target's prior consists: one for each 16 buckets, times PRIOR.
PRIOR, PRIOR_BUCKETS = 20.0, BUCKETS / 16
#: Rejecting a good document costs as much as keeping so many bad ones: what is rejected is lost, what is kept meets later stages.
GOOD_COST = 10.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_FEATURE = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x00-\x20]+")
_OTHERS = bytes(set(range(256)) - set(_SYMBOLS))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_features long, score double, base_failed boolean, kept boolean"


class _Buckets(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


_BUCKETS = _Buckets()
register("features", _BUCKETS.clear)


def feature_buckets(text: bytes | None) -> np.ndarray:
    """The buckets of all single features and neighbouring pairs of a text."""
    tokens = _FEATURE.findall(text or b"")
    h = np.fromiter(map(_BUCKETS.__getitem__, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs ^= pairs >> np.uint64(29)
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def base_statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum()) - (len(text) - len(text.translate(None, _SPACES)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        covered = np.zeros(n + 3, np.int32)
        at = np.fromiter((i for i, w in enumerate(windows) if often[w] > 1), np.int64)
        for k in range(3):
            covered[at + k] = 1
        repeated = int(covered.sum())
    return n, chars, len(text.translate(None, _OTHERS)), len(lines) - len(set(lines)), repeated


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass
class Model:
    log_ratio: np.ndarray
    threshold: float

    def score(self, text: bytes | None) -> tuple[int, float]:
        """The number of features and their mean log ratio (0.0 where there are none)."""
        b = feature_buckets(text)
        return len(b), round(float(self.log_ratio[b].mean()), 9) if len(b) else 0.0


def _label_sample(labels: DataFrame, max_trusted: int) -> list[tuple[int, int]]:
    """At most ``max_trusted`` ids of each quality, the least by hash: a bounded sample of labelled rows."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    ids = ids.withColumn("h", F.xxhash64("doc_id"))
    picked = [ids.where(F.col("q") == q).orderBy("h", "doc_id").limit(max_trusted) for q in (0, 1)]
    return [(r.doc_id, int(r.q)) for r in picked[0].unionByName(picked[1]).collect()]


def _add(held: tuple[list[np.ndarray], list[np.ndarray]], raw: np.ndarray, target: np.ndarray) -> None:
    """Add the buckets of other and of trusted texts to the counts."""
    for buckets, into in ((held[0], (raw,)), (held[1], (raw, target))):
        if buckets:
            n = np.bincount(np.concatenate(buckets), minlength=BUCKETS)
            for counts in into:
                counts += n


def _counts(it, trusted: frozenset[int]):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in it:
        known = [d in trusted for d in batch.column(0).to_pylist()]
        held, size = ([], []), 0
        for text, t in zip(utf8(batch.column(1)), known):
            b = feature_buckets(text)
            held[t].append(b)
            size += len(b)
            if size > 1 << 20:
                _add(held, raw, target)
                held, size = ([], []), 0
        _add(held, raw, target)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def _scores_of(it, model: Model):
    for batch in it:
        passed = []
        for d, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            n, *_, rep = base_statistics(text)
            if not base_fails(n, rep):
                passed.append((d, model.score(text)[1]))
        yield pa.RecordBatch.from_pylist([{"doc_id": d, "score": s} for d, s in passed], pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))


def best_threshold(scores: list[tuple[float, int]], good_cost: float = GOOD_COST) -> float:
    """The cut with the best sum of both classes' shares that fall on their right side.

    Rejecting a good document costs as much as keeping ``good_cost`` bad ones.  Of equally good cuts
    the lowest counts, and it lies in the middle of the gap there.  Without both classes:
    -inf, nothing is rejected.
    """
    good = sorted(s for s, q in scores if q)
    bad = sorted(s for s, q in scores if not q)
    if not good or not bad:
        return float("-inf")
    cuts = np.unique(np.array(good))
    kept_good = 1 - np.searchsorted(good, cuts, "left") / len(good)
    cut_bad = np.searchsorted(bad, cuts, "left") / len(bad)
    value = good_cost * kept_good + cut_bad
    best = float(cuts[int(np.flatnonzero(value >= value.max() - 1e-12)[0])])
    below = [s for s in bad if s < best]
    return (best + below[-1]) / 2 if below else float("-inf")


def fit(documents: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED, smoothing: float = SMOOTHING) -> Model:
    """Count both multinomials and set the threshold; one pass over all documents, one over the labelled sample."""
    docs = id_text(documents)
    sample = _label_sample(labels, max_trusted)
    half = lambda d: xxhash.xxh3_64_intdigest(str(d).encode()) & 1
    trusted = frozenset(d for d, q in sample if q and not half(d))
    tuned = {d: q for d, q in sample if half(d)}
    counted = map_batches(docs, lambda it: _counts(it, trusted), "bucket long, raw long, target long", ("features",))
    rows = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    if not target.sum():
        return Model(np.zeros(BUCKETS), float("-inf"))
    p_raw = (raw + smoothing) / (raw.sum() + smoothing * BUCKETS)
    # The target is drawn towards the raw corpus where it has seen little: its prior is the raw multinomial.
    prior = PRIOR * smoothing * PRIOR_BUCKETS
    p_target = (target + prior * p_raw) / (target.sum() + prior)
    model = Model(np.log(p_target) - np.log(p_raw), float("-inf"))
    ids = documents.sparkSession.createDataFrame([(d,) for d in tuned], "doc_id long")  # max_trusted rows of each class at most
    scored = map_batches(id_text(documents).join(F.broadcast(ids), "doc_id", "left_semi"), lambda it: _scores_of(it, model), "doc_id long, score double", ("features",))
    model.threshold = best_threshold([(s, tuned[d]) for d, s in scored.collect()])
    return model


def _judge(it, model: Model):
    for batch in it:
        rows = []
        for text in utf8(batch.column(1)):
            n, chars, symbols, dup, rep = base_statistics(text)
            k, s = model.score(text)
            failed = base_fails(n, rep)
            rows.append((n, chars, symbols, dup, rep, k, s, failed, not failed and s >= model.threshold))
        cols = list(zip(*rows)) or [()] * 9
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def judge(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document row with its statistics, score and verdict.

    Null and empty texts have no words and fail the base rules.  Repeated rows and rows
    with a null id are judged each by itself; other columns are not read.  An empty
    table gives an empty result.
    """
    return map_batches(id_text(documents), lambda it: _judge(it, model), SCHEMA, ("features",))


def _kept_rows(it, model: Model, at: int):
    for batch in it:
        keep = []
        for text in utf8(batch.column(at)):
            n, *_, rep = base_statistics(text)
            keep.append(not base_fails(n, rep) and model.score(text)[1] >= model.threshold)
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that :func:`judge` keeps, with all their columns.

    Null and empty texts go, as they fail the base rules; rows without a doc_id and repeated
    rows are judged each by itself; whole texts are read, however long; an empty table gives
    an empty result.
    """
    at = documents.columns.index("text")
    return map_batches(documents, lambda it: _kept_rows(it, model, at), documents.schema, ("features",))
