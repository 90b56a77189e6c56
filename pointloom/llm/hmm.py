"""A hidden Markov language model, trained by Baum-Welch counts that are summed across partitions.

Words are lower-cased (A-Z); each text ends with one end token.  A hidden state emits a
class: the end, one of the ``HEAD`` most frequent words (all that are looked up), or one of
``TAIL`` classes of all other words by their last bytes; a class emits its words by their corpus counts,
(c+1)/(C+V+1) with C tokens and V words in the class, so that an unknown word has a share.
The likelihood of a text is exact: the scaled forward recursion over its classes, times the
words' shares.

Counts of words cover all training texts.  The ``LOOKUP`` most frequent words, of at most
``MAX_BYTES`` bytes, go to every task; counts of all others meet their texts in a join, as
(row, word, times) of rare words only.  A first guess of the states is trained on the driver
from at most ``GUESS_ROWS`` whole texts of any length, the least by a hash of their doc_id, as
far as they hold ``GUESS_TOKENS`` tokens together; then every training text counts in each of
``ITERATIONS`` rounds.  Long texts are counted span by span, with forward and backward values
carried across, so no text is cut.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, utf8, written

STATES = 8
ITERATIONS = 3
LOOKUP, TAIL, MAX_BYTES = 65_536, 2048, 64
#: Words with emissions of their own: every word that is looked up.
HEAD = LOOKUP
SYMBOLS = 1 + HEAD + TAIL
GUESS_ROWS, GUESS_TOKENS, GUESS_ROUNDS = 400, 1 << 19, 15
FOLDS, HELD_OUT = 7, 2
#: Tokens whose forward and backward values a task holds at once.
SPAN = 1 << 17
#: Tokens of texts that a task holds, to take texts of like length together.
HELD = 16 * SPAN
#: Steps between scalings; a step's probabilities are far above the EVERY-th root of the least double.
EVERY = 8
#: Times the corpus' shares that are added to each state's counts.
PRIOR = 50.0
_END = b""


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def tail_class(word: bytes) -> int:
    return 1 + HEAD + zlib.crc32(word[-3:]) % TAIL


def rows_of(documents: DataFrame) -> DataFrame:
    """doc_id, text, held_out: out of training are ids whose crc32, as text, leaves HELD_OUT; rows without an id are in it."""
    out = F.crc32(F.col("doc_id").cast("long").cast("string")) % FOLDS == HELD_OUT
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(out, F.lit(False)).alias("held_out"))


# Counts of words


def _count(it):
    of, ends = Counter(), 0

    def flush():
        yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.binary()), pa.array(list(of.values()), pa.int64())], names=["word", "n"])
        of.clear()

    for b in it:
        for text in utf8(b.column(0)):
            of.update(_words(text))
            ends += 1
            if len(of) > 150_000:
                yield from flush()
    if ends:
        of[_END] += ends
    yield from flush()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) of the training texts, the end as an empty word; a table already written."""
    counted = map_batches(rows.where("not held_out").select("text"), _count, "word binary, n long")
    return written(counted.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")


@dataclass
class Vocabulary:
    tokens: int
    words: int
    ends: int
    at: dict[bytes, int]
    log_c: np.ndarray
    symbol: np.ndarray
    #: log10(C+V+1) of each tail class by symbol, 0 for symbols that are words; the corpus' tokens by symbol.
    log_z: np.ndarray
    mass: np.ndarray


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max(F.when(F.length("word") == 0, F.col("c"))).alias("e")).first()
    # The LOOKUP most frequent words, by a histogram of counts with 16 bins per doubling; of the last bin a part by hash.
    short = counts.where((F.length("word") > 0) & (F.length("word") <= MAX_BYTES)).withColumn("bin", F.floor(16 * F.log2("c")))
    room, taken = LOOKUP, F.lit(True)
    for r in sorted(short.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):  # 16 x 63 rows at most
        if r.n > room:
            part = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int((1 << 30) * room / r.n)
            taken = (F.col("bin") > r.bin) | ((F.col("bin") == r.bin) & part)
            break
        room -= r.n
    top = short.where(taken).select("word", "c").collect()  # about LOOKUP rows of MAX_BYTES
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    del top[LOOKUP:]
    words = [bytes(r.word) for r in top]
    c = np.array([r.c for r in top], np.float64)
    symbol = np.array([1 + i if i < HEAD else tail_class(w) for i, w in enumerate(words)], np.int64)
    tail = (F.crc32(F.substring("word", -3, 3)) % TAIL + 1 + HEAD).alias("s")
    z, mass = np.ones(SYMBOLS), np.zeros(SYMBOLS)
    for r in counts.where(F.length("word") > 0).groupBy(tail).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # TAIL rows
        z[r.s] += r.c + r.v
        mass[r.s] = r.c
    for i, w in enumerate(words[:HEAD]):  # words that are symbols of their own are not in their tail class
        z[tail_class(w)] -= c[i] + 1
        mass[tail_class(w)] -= c[i]
        mass[1 + i] = c[i]
    mass[0] = total.e or 0
    log_z = np.log10(z)
    log_z[: 1 + HEAD] = 0
    return Vocabulary(total.n or 0, total.v, total.e or 0, {w: i for i, w in enumerate(words)}, np.log10(c + 1), symbol, log_z, mass)


# Texts as classes


class _At(dict):
    def __missing__(self, word):
        return -1


_ENCODED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("log_all", pa.float64()), ("log_within", pa.float64()), ("symbols", pa.binary()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))])
_ENCODED_SQL = "rid long, doc_id long, held_out boolean, n_tokens long, known long, log_all double, log_within double, symbols binary, tail array<struct<word: binary, n: long>>"


def _encode(it, shared):
    v: Vocabulary = shared.value
    at, base, made = _At(v.at), TaskContext.get().partitionId() << 36, 0
    log_end = float(np.log10(v.ends + 1))
    for b in it:
        rows, ends, tail_words, tail_counts = [], [0], [], []
        for doc, text, held in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist()):
            words = _words(text)
            k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            s = np.zeros(len(words) + 1, np.uint32)
            rare = np.flatnonzero(k < 0)
            known = np.flatnonzero(k >= 0)
            s[known] = v.symbol[k[known]]
            tails = [words[i] for i in rare]
            s[rare] = [tail_class(w) for w in tails]
            log_c = v.log_c[k[known]]
            in_tail = v.symbol[k[known]] > HEAD
            within = float(log_c[in_tail].sum()) - float(v.log_z[s].sum())
            rows.append((base + made, doc, held, len(s), len(known) + (v.ends > 0), float(log_c.sum()) + log_end, within, s.tobytes()))
            counted = Counter(tails)
            tail_words += counted
            tail_counts += counted.values()
            ends.append(len(tail_words))
            made += 1
        if rows:
            entries = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()), pa.array(tail_counts, pa.int64())], names=["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), _ENCODED.types)), tail], schema=_ENCODED)


# The states


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # SYMBOLS x states


def _grouped(seqs: list[np.ndarray], limit: int):
    """Sequences by falling length, in groups of at most ``limit`` padded tokens."""
    group: list[int] = []
    for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
        if group and (len(group) + 1) * len(seqs[group[0]]) > limit:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by step and sequence (longest first), and how many sequences have each step."""
    n = np.array([len(s) for s in seqs])
    obs = np.zeros((n[0], len(seqs)), np.uint32)
    for i, s in enumerate(seqs):
        obs[: len(s), i] = s
    return obs, np.searchsorted(-n, -np.arange(n[0]), "left")


def log_likelihoods(model: Model, seqs: list[np.ndarray], limit: int = SPAN) -> np.ndarray:
    """log10 of each sequence's probability by the scaled forward recursion, all of a group step by step.

    Forward values are scaled to a sum of one at every EVERY-th step, and the scales' logarithms add up.
    """
    out, ones = np.zeros(len(seqs)), np.ones(len(model.start))
    for group in _grouped(seqs, limit):
        obs, active = _padded([seqs[i] for i in group])
        total, a = np.zeros(len(group)), None
        for lo in range(0, len(obs), 256):
            e = model.emit[obs[lo : lo + 256]]
            for t in range(len(e)):
                n = active[lo + t]
                a = model.start * e[t, :n] if a is None else a[:n] @ model.move * e[t, :n]
                if (lo + t) % EVERY == EVERY - 1:
                    c = a @ ones
                    a /= c[:, None]
                    total[:n] += np.log10(c)
                after = active[lo + t + 1] if lo + t + 1 < len(obs) else 0
                if after < n:
                    total[after:n] += np.log10(a[after:] @ ones)
        out[group] = total
    return out


def _add_counts(model: Model, obs: np.ndarray, active: np.ndarray, sums: Model, enter: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Add a group's expected counts to ``sums``.

    A span of a longer text is a group of one: ``enter`` has the forward values before it,
    ``after`` what stands after it, emission times backward; returned is the same for its own
    first step.
    """
    k, ones, back = len(model.start), np.ones(len(model.start)), np.ascontiguousarray(model.move.T)
    steps, width = obs.shape
    e = model.emit[obs]
    alpha, beta = np.zeros((steps, width, k)), np.ones((steps, width, k))
    for t in range(steps):
        n = active[t]
        a = alpha[t, :n]
        if t or enter is not None:
            np.matmul(alpha[t - 1, :n] if t else enter[None, :], model.move, out=a)
            a *= e[t, :n]
        else:
            np.multiply(model.start, e[0], out=a)
        if t % EVERY == EVERY - 1:
            a /= (a @ ones)[:, None]
    if after is not None:
        beta[-1] = after @ back
        beta[-1] /= beta[-1].sum()
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        e[t + 1, :m] *= beta[t + 1, :m]
        e[t + 1, m:] = 0
        b = beta[t, :m]
        np.matmul(e[t + 1, :m], back, out=b)
        if t % EVERY == 0:
            b /= (b @ ones)[:, None]
    # Moves: forward at t, move, and what stands in e at t + 1: emission times backward, 0 beyond a sequence's end.
    f, g = alpha[:-1].reshape(-1, k), e[1:].reshape(-1, k)
    if after is not None:
        f, g = np.concatenate([f, alpha[-1]]), np.concatenate([g, after[None, :]])
    z = np.einsum("ij,ij->i", f @ model.move, g)
    z[z == 0] = 1
    sums.move += (f / z[:, None]).T @ g * model.move
    first = e[0, 0] * beta[0, 0]
    alpha *= beta
    gamma = alpha.reshape(-1, k)
    z = gamma @ ones
    z[z == 0] = 1
    gamma /= z[:, None]
    if enter is None:
        sums.start += gamma[:width].sum(axis=0)
    flat, weights = obs.reshape(-1).astype(np.int64), np.ascontiguousarray(gamma.T)
    for j in range(k):
        sums.emit[:, j] += np.bincount(flat, weights=weights[j], minlength=SYMBOLS)
    return first / first.sum()


def _add_long(model: Model, seq: np.ndarray, sums: Model, span: int) -> None:
    """A text of more than one span: forward values at the cuts first, then the spans from the last to the first."""
    cuts, enter = range(0, len(seq), span), [None]
    for lo in cuts[:-1]:
        a = enter[-1]
        for row in model.emit[seq[lo : lo + span]]:
            a = model.start * row if a is None else a @ model.move * row
            a = a / a.sum()
        enter.append(a)
    after = None
    for lo, a in zip(reversed(cuts), reversed(enter)):
        part = seq[lo : lo + span]
        after = _add_counts(model, part[:, None], np.ones(len(part), np.int64), sums, a, after)


def expected_counts(model: Model, seqs: list[np.ndarray], limit: int = SPAN) -> Model:
    """Baum-Welch: expected starts, moves and emissions of the sequences, as a model of sums.

    Forward and backward values are scaled at every EVERY-th step only; each step's
    posteriors are scaled to one afterwards, for all steps at once.
    """
    k = len(model.start)
    sums = Model(np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k), order="F"))  # added to by column
    for group in _grouped(seqs, limit):
        if len(seqs[group[0]]) > limit:
            _add_long(model, seqs[group[0]], sums, limit)
        else:
            _add_counts(model, *_padded([seqs[i] for i in group]), sums)
    return sums


def estimated(sums: Model, shares: np.ndarray) -> Model:
    """The model of expected counts; ``shares`` are the corpus' class shares, positive for every class that a text can have."""
    emit = sums.emit + PRIOR * shares[:, None]
    move, start = sums.move + 0.1, sums.start + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def first_guess(seqs: list[np.ndarray], shares: np.ndarray, states: int) -> Model:
    """States from a small sample: fixed noise on the corpus' shares, states that last, then Baum-Welch rounds."""
    noise = np.random.default_rng(7).gamma(1.0, size=(SYMBOLS, states)) + 0.1
    emit = shares[:, None] * noise
    move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    model = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    for _ in range(GUESS_ROUNDS if seqs else 0):
        model = estimated(expected_counts(model, seqs), shares)
    return model


def _expect(it, shared):
    model: Model = shared.value
    k = len(model.start)
    total = Model(np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS, k), order="F"))
    held: list[np.ndarray] = []

    def add():
        m = expected_counts(model, held)
        total.start += m.start
        total.move += m.move
        total.emit += m.emit
        held.clear()

    size = 0
    for b in it:
        for symbols in b.column(0).to_pylist():
            held.append(np.frombuffer(symbols, np.uint32))
            size += len(held[-1])
            if size > HELD:
                add()
                size = 0
    if held:
        add()
    values = np.concatenate([total.start[None, :], total.move, total.emit])
    used = np.flatnonzero(values.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64())] + [pa.array(values[used, j]) for j in range(k)], names=["row", *(f"s{j}" for j in range(k))])


def train(encoded: DataFrame, shares: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all training rows; a round's sums are SYMBOLS + states + 1 rows once added up."""
    rows = encoded.where("not held_out")
    picked, room = [], GUESS_TOKENS
    for r in rows.select("rid", "n_tokens").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens", "log_all", "rid").limit(GUESS_ROWS).collect():
        if r.n_tokens <= room:
            picked.append(r.rid)
            room -= r.n_tokens
    small = sorted(rows.where(F.col("rid").isin(picked)).select("n_tokens", "symbols").collect()) if picked else []
    model = first_guess([np.frombuffer(r.symbols, np.uint32) for r in small], shares, states)
    names = [f"s{j}" for j in range(states)]
    for _ in range(iterations):
        shared = encoded.sparkSession.sparkContext.broadcast(model)
        parts = map_batches(rows.select("symbols"), lambda it, s=shared: _expect(it, s), ", ".join(["row long", *(f"{n} double" for n in names)]))
        values = np.zeros((1 + states + SYMBOLS, states))
        for r in parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).collect():
            values[r[0]] = r[1:]
        model = estimated(Model(values[0], values[1 : 1 + states], values[1 + states :]), shares)
    return model


_PASSED = ["rid", "doc_id", "held_out", "n_tokens", "known", "log_all", "log_within"]


def _score(it, shared):
    at = len(_PASSED)

    def scored(held):
        logs = log_likelihoods(shared.value, [np.frombuffer(x, np.uint32) for b in held for x in b.column(at).to_pylist()])
        lo = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array(logs[lo : lo + b.num_rows], pa.float64())], names=[*_PASSED, "log_classes"])
            lo += b.num_rows

    held, size = [], 0
    for b in it:
        held.append(b)
        size += b.column(at).nbytes // 4
        if size > HELD:
            yield from scored(held)
            held, size = [], 0
    if held:
        yield from scored(held)


def score(documents: DataFrame, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of documents.

    ``base_score`` is the sum over tokens of log10((c+1)/(N+V+1)), ``score`` the model's log10
    probability of the text.  Null and empty texts are the end alone.  Repeated rows are
    texts each, in training too.  Without any training text all words are unknown.  Other
    columns are not read; an empty table gives an empty result.
    """
    sc = documents.sparkSession.sparkContext
    rows = rows_of(documents)
    counts = word_counts(rows)
    v = vocabulary(counts)
    shared = sc.broadcast(v)
    encoded = written(map_batches(rows, lambda it: _encode(it, shared), _ENCODED_SQL), "texts-as-classes")
    shares = v.mass + 1
    shares[1 + len(v.at) : 1 + HEAD] = 0  # symbols without a word take nothing from the others
    shares /= shares.sum()
    model = sc.broadcast(train(encoded, shares, states, iterations))
    forward = map_batches(encoded.select(*_PASSED, "symbols"), lambda it: _score(it, model), "rid long, doc_id long, held_out boolean, n_tokens long, known long, log_all double, log_within double, log_classes double")
    rare = encoded.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.n")
    found = rare.join(counts.where(F.length("word") > 0), "word").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_rare"), F.sum("n").alias("rare_known"))
    out = forward.join(found, "rid", "left")
    rest = F.coalesce("log_rare", F.lit(0.0))
    norm = float(np.log10(v.tokens + v.words + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("log_all") + rest - F.col("n_tokens") * norm).alias("base_score"), (F.col("log_classes") + F.col("log_within") + rest).alias("score"))
