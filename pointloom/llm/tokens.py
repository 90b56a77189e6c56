"""Token ids of whole texts by a public tokenizer that splits at white space.

The tokenizer never merges across white space, so a text's ids are those of its
words in a row.  Its special tokens are found in a text as it is written, before letters
are lower-cased; so words that may hold one keep their case.  Each worker keeps a table
of the words it has met; a text costs one look-up per word and one vectorised gather.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

from .caches import register

END_ID = 2
MAX_WORDS = 400_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters, then ASCII marks without the apostrophe: for these the tokenizer's own splits are known, and its
#: model is asked directly.  All letters here are under U+0250, lower case, and composed.
_PLAIN = re.compile(r"([a-zªµºß-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
_ASCII = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]*)")
#: Byte-level vocabularies write a byte that isn't a visible Latin-1 character as U+0100 and following, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOW = dict(zip((b for b in range(256) if b not in _SHOWN), range(256, 512)))


_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _known_splits(spec: dict) -> bool:
    """Whether a tokenizer lower-cases, cuts words as :data:`_PLAIN` expects and shows bytes as :data:`_SHOW` does."""
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    by_pattern = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _SPLIT} and cuts[0].get("invert") is True
    return steps == ["NFC", "Replace", "Lowercase"] and by_pattern and cuts[1]["type"] == "ByteLevel" and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]


def _shown(part: str) -> str:
    return part if part.isascii() else part.encode().decode("latin-1").translate(_SHOW)


class _Numbers(dict):
    """Words numbered in the order they are first asked for; ``new`` are those not encoded yet."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTokens:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    _loaded: dict[str, "WordTokens"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        #: The first two bytes of each special token: words with them are looked up in their own case.
        self._marks = sorted({t.content.encode()[:2] for t in self._tokenizer.get_added_tokens_decoder().values()})
        self._direct = _known_splits(json.loads(self._tokenizer.to_str()))
        self._clear()

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _clear(self) -> None:
        self._at = _Numbers()
        self._start = np.zeros(1024, np.int64)
        self._len = np.zeros(1024, np.int64)
        self._flat = np.zeros(4096, np.uint32)
        self._used = 0

    def _learn(self) -> None:
        words, self._at.new = self._at.new, []
        try:
            got = [self._encoded(w) for w in words]
        except BaseException:
            self._clear()
            raise
        n = np.fromiter(map(len, got), np.int64, len(got))
        k, used = len(self._at) - len(words), self._used + int(n.sum())
        while len(self._at) > len(self._start):
            self._start, self._len = np.concatenate([self._start, self._start]), np.concatenate([self._len, self._len])
        while used > len(self._flat):
            self._flat = np.concatenate([self._flat, self._flat])
        self._start[k : k + len(words)] = self._used + np.cumsum(n) - n
        self._len[k : k + len(words)] = n
        self._flat[self._used : used] = list(chain.from_iterable(got))
        self._used = used

    def _encoded(self, word: bytes) -> list[int]:
        if self._direct and (m := _ASCII.fullmatch(word)):
            letters, marks = m.groups()
            ids = [t.id for t in self._model.tokenize(letters.decode())]
            return ids + [t.id for t in self._model.tokenize(marks.decode())] if marks else ids
        word = word.decode("utf-8", "replace")
        if self._direct and (m := _PLAIN.fullmatch(word)) and (letters := m[1]).isalpha() and letters == letters.lower():
            return [t.id for part in m.groups() if part for t in self._model.tokenize(_shown(part))]
        return self._tokenizer.encode(word, add_special_tokens=False).ids

    def ids(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint32)
        if self._marks and any(m in text for m in self._marks):
            words = [w if any(m in w for m in self._marks) else w.lower() for w in text.split()]
        if len(self._at) > MAX_WORDS:
            self._clear()
        k = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        if self._at.new:
            self._learn()
        n = self._len[k]
        ends = np.cumsum(n)
        return self._flat[np.arange(ends[-1]) + np.repeat(self._start[k] - ends + n, n)]


register("tokens", WordTokens._loaded.clear)
