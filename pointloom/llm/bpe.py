"""Byte-level BPE encoding with a transducer lexicon, and decoding.

Texts are cut into words as the tokenizer's pattern does, but over arrays of code points: a word
begins where the class of the characters changes, but for spaces, which go to the word behind
them, for the last of several white characters, and for the English contractions.  The words
that are frequent in the corpus are compiled with their ids into a minimal acyclic transducer
(:mod:`.lexicon`), which workers map into memory and walk for all words of a piece side by
side.  Words it doesn't have are merged exactly, by the tokenizer's own merges.  So the
lexicon decides how fast a text is encoded, never how.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon
from .caches import register
from .frames import drop_paths, id_text, map_batches, new_path, utf8, written
from .tokens import _SHOW

#: So many of the corpus' most frequent words are compiled, and none beyond so many characters.
LEXICON_WORDS = 131_072
LONGEST_WORD = 48
#: Counts of words are told apart by so many steps from one power of two to the next.
COUNT_STEPS = 32
#: Code points that are cut and looked up at a time; the arrays of a piece take some 40 bytes for each.
PIECE = 1 << 19
#: A task sends its counts of words on when it holds so many.
HELD = 200_000
#: Words that a worker keeps beside the lexicon with their ids.
MAX_WORDS = 200_000
OUT_BYTES = 8 << 20
_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE_CLASS = range(5)
#: Stands behind each segment of a text, where nothing is seen of what follows.
EDGE = lexicon.POINTS - 1
_HIDDEN = {v: k for k, v in _SHOW.items()}
_PATTERN_OF = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shown(word: str) -> str:
    """A word's bytes as the vocabulary writes them."""
    return word.encode("utf-8", "replace").decode("latin-1").translate(_SHOW)


def _bytes_of(token: str) -> bytes:
    """What a token of the vocabulary stands for; other texts stand for themselves."""
    points = [_HIDDEN.get(ord(c), ord(c)) for c in token]
    known = all(p < 256 and (ord(c) == p) == (p not in _SHOW) for c, p in zip(token, points))
    return bytes(points) if known else token.encode()


class Merges:
    """A tokenizer file's own merges, tokens and added tokens."""

    _loaded: dict[str, "Merges"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        spec = json.loads(t.to_str())
        added = t.get_added_tokens_decoder()
        plain = all(not (a.lstrip or a.rstrip or a.single_word or a.normalized) for a in added.values())
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec.get("pre_tokenizer") != _PATTERN_OF or (spec.get("decoder") or {}).get("type") != "ByteLevel" or not plain:
            raise ValueError("not a byte-level BPE that cuts texts by its standard pattern")
        self._tokenizer, self._model = t, t.model  # the model lives as long as the tokenizer
        self.added = {a.content: i for i, a in added.items()}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        table: list[bytes] = [b""] * (max([*t.get_vocab(True).values(), *added]) + 1)
        for token, i in t.get_vocab(False).items():
            table[i] = _bytes_of(token)
        for i, a in added.items():
            table[i] = _bytes_of(a.content)
        self._size = np.fromiter(map(len, table), np.int64, len(table))
        self._start = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(table), np.uint8)

    @classmethod
    def of(cls, path: str) -> "Merges":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def ids(self, word: str) -> list[int]:
        return [t.id for t in self._model.tokenize(_shown(word))]

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; unknown ids stand for none."""
        out = []
        for at in range(0, len(ids), PIECE):
            some = ids[at : at + PIECE]
            some = some[some < len(self._size)]
            out.append(_gathered(self._bytes, self._start[some], self._size[some]).tobytes())
        return b"".join(out)

    def classes(self) -> np.ndarray:
        """The class of every code point, as the tokenizer's own pattern has it.

        Characters are presumed letters, numbers or white as the ``regex`` library says, and each
        run of them is shown to the tokenizer behind one of its kind: it stays whole if
        the tokenizer agrees.  What does not is asked about character by character.
        """
        import regex

        everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        out = np.full(lexicon.POINTS, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, everything):
                out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        out[0xD800:0xE000] = _OTHER
        cut = self._tokenizer.pre_tokenizer.pre_tokenize_str
        lead = {_OTHER: "!", _LETTER: "a", _NUMBER: "1"}

        def whole(kind: int, points: list[int]) -> bool:
            return len(cut(lead[kind] + "".join(map(chr, points)))) == 1

        def kind_of(point: int) -> int:
            return next((k for k in lead if whole(k, [point])), _SPACE)

        edges = np.flatnonzero(np.diff(out[:EDGE], prepend=255, append=255))
        for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
            points = [p for p in range(lo, hi) if not 0xD800 <= p < 0xE000]
            kind = int(out[lo])
            if points and (kind == _SPACE or not whole(kind, points)):
                for p in points:
                    out[p] = kind_of(p)
        out[EDGE] = _EDGE_CLASS
        return out


register("merges", Merges._loaded.clear)


def _gathered(flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``flat[start : start + n]`` of all, one behind the other."""
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + n, n)]


def word_starts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where words begin in segments of text that each end in an :data:`EDGE`, which is a word by itself."""
    kind = classes[points]
    before, behind = np.concatenate([[_EDGE_CLASS], kind[:-1]]), np.concatenate([kind[1:], [_EDGE_CLASS]])
    edge, space = kind == _EDGE_CLASS, kind == _SPACE
    start = (kind != before) | edge
    blank = np.concatenate([[False], points[:-1] == 32])
    start &= ~blank | space | edge  # a space goes to the word behind it
    start |= space & (behind != _SPACE) & (behind != _EDGE_CLASS)  # of several white characters the last stands apart
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[mark + 2 < len(points)]
    a, b = points[mark + 1], points[mark + 2]
    two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # 're 've 'll
    one = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # 's 't 'm 'd
    mark, size = mark[one | two], np.where(one, 2, 3)[one | two]
    start[mark + 1] = False
    on = mark + size
    start[on[on < len(points)]] = True
    return np.flatnonzero(start)


def _parts(points: np.ndarray, classes: np.ndarray) -> Iterator[np.ndarray]:
    """A segment in pieces, cut in front of white characters behind others: a word begins there whatever stands around."""
    at = 0
    while len(points) - at > PIECE:
        lo, step, cut = at + PIECE, 4096, None
        while lo < len(points):
            white = classes[points[lo - 1 : lo + step]] == _SPACE
            if len(found := np.flatnonzero(white[1:] & ~white[:-1])):
                cut = lo + int(found[0])
                break
            lo, step = lo + step, 2 * step
        if cut is None:
            break
        yield points[at:cut]
        at = cut
    yield points[at:]


class _Pieces:
    """Texts as pieces of about ``PIECE`` code points.

    Each is the points, and for every edge in them the number of the added token that stands
    there, or ``END`` of a text, or ``ON`` where the text goes on.
    """

    END, ON = -1, -2

    def __init__(self, merges: Merges, classes: np.ndarray):
        self.merges, self.classes = merges, classes

    def _segments(self, text: str) -> Iterator[tuple[str, int]]:
        at = 0
        if self.merges.pattern is not None:
            for m in self.merges.pattern.finditer(text):
                yield text[at : m.start()], self.merges.added[m[0]]
                at = m.end()
        yield (text[at:] if at else text), self.END

    def of(self, texts: Iterator[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.array([EDGE], np.uint32)
        held, edges, size = [], [], 0
        for raw in texts:
            for segment, what in self._segments((raw or b"").decode("utf-8", "replace")):
                points = np.frombuffer(segment.encode("utf-32-le"), np.uint32)
                parts = list(_parts(points, self.classes)) if len(points) > PIECE else [points]
                for i, part in enumerate(parts, 1):
                    held += [part, edge]
                    edges.append(what if i == len(parts) else self.ON)
                    size += len(part) + 1
                    if size >= PIECE:
                        yield np.concatenate(held), np.array(edges, np.int64)
                        held, edges, size = [], [], 0
        if held:
            yield np.concatenate(held), np.array(edges, np.int64)


class Encoder:
    """A lexicon, and the ids of further words that a worker has met."""

    _loaded: dict[tuple[str, str], "Encoder"] = {}

    def __init__(self, path: str, uri: str):
        self.merges, self.lexicon = Merges.of(path), lexicon.load(uri)
        self.pieces = _Pieces(self.merges, self.lexicon.classes)
        self._clear()

    @classmethod
    def of(cls, path: str, uri: str) -> "Encoder":
        if (path, uri) not in cls._loaded:
            cls._loaded.clear()
            cls._loaded[path, uri] = cls(path, uri)
        return cls._loaded[path, uri]

    def _clear(self) -> None:
        lex = self.lexicon
        self._flat, self._used = np.array(lex.ids), len(lex.ids)
        self._start, self._n = np.array(lex.id_starts[:-1]), np.diff(lex.id_starts)
        self._count = lex.n_words
        self._met: dict[bytes, int] = {}
        self._nothing = self._learn([[]])
        self._added = {i: self._learn([[i]]) for i in self.merges.added.values()}

    def _learn(self, words: list[list[int]]) -> int:
        """Puts words' ids behind the table; the number of the first."""
        first, n = self._count, np.fromiter(map(len, words), np.int64, len(words))
        self._count += len(words)
        used = self._used + int(n.sum())
        while self._count > len(self._start):
            self._start, self._n = np.concatenate([self._start, np.zeros(len(self._start) + 1024, np.int64)]), np.concatenate([self._n, np.zeros(len(self._n) + 1024, np.int64)])
        while used > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(len(self._flat) + 4096, np.uint32)])
        self._start[first : self._count], self._n[first : self._count] = self._used + np.cumsum(n) - n, n
        self._flat[self._used : used] = [i for w in words for i in w]
        self._used = used
        return first

    def _numbers(self, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table's number of each word of a piece, and which of them are edges."""
        starts = word_starts(points, self.lexicon.classes)
        ends = np.append(starts[1:], len(points))
        number = self.lexicon.find(points, starts, ends)
        at_edge = points[starts] == EDGE
        number[at_edge] = [self._added.get(e, self._nothing) for e in edges.tolist()]
        unseen = np.flatnonzero(number < 0)
        if len(unseen):
            raw, met = points.tobytes(), self._met
            words = [raw[4 * a : 4 * b] for a, b in zip(starts[unseen].tolist(), ends[unseen].tolist())]
            if new := [w for w in dict.fromkeys(words) if w not in met]:
                first = self._learn([self.merges.ids(w.decode("utf-32-le")) for w in new])
                met.update(zip(new, range(first, first + len(new))))
            number[unseen] = [met[w] for w in words]
        return number, at_edge

    def ids(self, texts: Iterator[bytes | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        held: list[np.ndarray] = []
        for points, edges in self.pieces.of(texts):
            if len(self._met) > MAX_WORDS:
                self._clear()
            number, at_edge = self._numbers(points, edges)
            n = self._n[number]
            flat, ends, at = _gathered(self._flat, self._start[number], n), np.cumsum(n)[at_edge], 0
            for end in ends[edges == _Pieces.END].tolist():
                yield np.concatenate([*held, flat[at:end]]) if held else flat[at:end]
                held, at = [], end
            if at < len(flat):
                held.append(flat[at:])


register("lexicon", Encoder._loaded.clear)


def _counted(it, path: str, classes: np.ndarray):
    pieces = _Pieces(Merges.of(path), classes)
    n: Counter[bytes] = Counter()

    def sent():
        words = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-32-le") for w in words], pa.string()), pa.array([n[w] for w in words], pa.int64())], names=["word", "n"])

    for b in it:
        for points, _ in pieces.of(utf8(b.column(1))):
            starts = word_starts(points, classes)
            ends = np.append(starts[1:], len(points))
            fit = (points[starts] != EDGE) & (ends - starts <= LONGEST_WORD)
            raw = points.tobytes()
            n.update([raw[4 * a : 4 * z] for a, z in zip(starts[fit].tolist(), ends[fit].tolist())])
            if len(n) >= HELD:
                yield from sent()
                n.clear()
    yield from sent()


def frequent_words(documents: DataFrame, most: int = LEXICON_WORDS, tokenizer: str | None = None, classes: np.ndarray | None = None) -> list[str]:
    """The words, of up to ``LONGEST_WORD`` characters, that occur most often in all documents, ``most`` at most.

    They are all words from a step of counts on, the lowest one with which they are no more than
    ``most``; so the driver gets these and a histogram of the steps, however many tasks count.
    """
    path = tokenizer or default_path()
    classes = Merges.of(path).classes() if classes is None else classes
    spark, scratch = documents.sparkSession, []
    words = map_batches(id_text(documents), lambda it: _counted(it, path, classes), "word string, n long", ("merges",))
    words = written(words.groupBy("word").agg(F.sum("n").alias("n")), "word-counts", scratch)
    step = F.floor(F.log2("n") * COUNT_STEPS)
    found = words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()  # 64 * COUNT_STEPS rows at most
    total = np.cumsum([r.words for r in found])
    lowest = [r.step for r, t in zip(found, total.tolist()) if t <= most]
    out = sorted(r.word for r in words.where(step >= lowest[-1]).select("word").collect()) if lowest else []  # ``most`` short words at most
    drop_paths(spark, scratch)
    return out


def compiled(spark: SparkSession, words: list[str], tokenizer: str | None = None, classes: np.ndarray | None = None) -> str:
    """The address of a transducer of words and their ids, a file in the shared folder."""
    merges = Merges.of(tokenizer or default_path())
    uri = new_path(spark, "lexicon")
    lexicon.save(lexicon.build({w: merges.ids(w) for w in words}, merges.classes() if classes is None else classes), uri)
    return uri


def _encoded(it, path: str, uri: str):
    encoder = Encoder.of(path, uri)
    names = ["doc_id", "n_tokens", "ids"]
    for b in it:
        docs, sizes, rows, held, at = b.column(0), [], [], 0, 0
        for ids in encoder.ids(utf8(b.column(1))):
            sizes.append(len(ids))
            rows.append(ids.astype("<u4").tobytes())
            held += 4 * len(ids)
            if held >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([docs.slice(at, len(rows)), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=names)
                at, sizes, rows, held = at + len(rows), [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([docs.slice(at, len(rows)), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=names)


def encode(documents: DataFrame, tokenizer: str | None = None, most: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every row's whole text.

    The ids are those of the tokenizers library without special tokens added; the tokenizer's
    own truncation and padding are not used.  A null or empty text has no ids.  Repeated
    rows are encoded each by itself, null ids of documents stay null, other columns are not
    read, and an empty table gives an empty result.  The lexicon's file stays in the shared
    folder, as the returned frame reads it.
    """
    path = tokenizer or default_path()
    classes = Merges.of(path).classes()
    uri = compiled(documents.sparkSession, frequent_words(documents, most, path, classes), path, classes)
    return map_batches(id_text(documents), lambda it: _encoded(it, path, uri), "doc_id long, n_tokens long, ids binary", ("lexicon", "merges"))


def _decoded(it, path: str, at: int):
    merges = Merges.of(path)
    for b in it:
        names, texts, held, first = b.schema.names, [], 0, 0

        def batch():
            part = b.slice(first, len(texts))
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(b.num_columns)], names=["text" if i == at else n for i, n in enumerate(names)])

        for ids in b.column(at):
            raw = ids.as_buffer()
            text = None if raw is None else merges.decoded(np.frombuffer(raw, "<u4")).decode("utf-8", "replace")
            texts.append(text)
            held += len(text or "")
            if held >= OUT_BYTES:
                yield batch()
                first, texts, held = first + len(texts), [], 0
        if texts:
            yield batch()


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """The table with ``text`` in place of the ids: what the tokenizers library's decode gives with special tokens kept.

    Bytes that are no UTF-8 become replacement characters, unknown ids nothing, null ids null.
    """
    path, at = tokenizer or default_path(), encoded.columns.index(ids_col)
    schema = ", ".join(f"`{'text' if i == at else n}` {'string' if i == at else t}" for i, (n, t) in enumerate(encoded.dtypes))
    return map_batches(encoded, lambda it: _decoded(it, path, at), schema, ("merges",))


def digest(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the text that they decode to.

    Whatever :func:`encode` gives of odd rows: an empty text is the digests of nothing.
    """
    back = decode(encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids"), "ids", tokenizer)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
