"""Words, hashes and shingles of whole texts, vectorised with NumPy.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; ``bytes.split()``
splits at exactly these six.  Texts are handled as UTF-8 bytes, so no text is too
odd to be read.  ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .caches import register

SHINGLE_WORDS = 5
#: A worker's table of words is emptied when it holds this many; it is a cache only.
CACHE_WORDS = 150_000
#: Marks at the ends of words, those that lead lines of a comment in source code among them.
_EDGE = b".,;:!?()[]{}\"'#*/;%<>-"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix(x) -> np.ndarray:
    return _mix(np.asarray(x, dtype=np.uint64))


class _Hashes(dict):
    def __init__(self, strip: bool):
        super().__init__()
        self.strip_edges = strip

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        key = word.lower()
        if self.strip_edges:
            key = key.strip(_EDGE)
        self[word] = h = xxhash.xxh3_64_intdigest(key) if key else 0
        return h


_PLAIN, _STRIPPED = _Hashes(False), _Hashes(True)
register("words", _PLAIN.clear)
register("stripped words", _STRIPPED.clear)


def word_hashes(words: list[bytes], strip: bool = False) -> np.ndarray:
    """64-bit hashes of lower-cased words; ``strip`` drops marks at their ends, and gives 0 for words of marks alone."""
    return np.fromiter(map((_STRIPPED if strip else _PLAIN).__getitem__, words), np.uint64, len(words))


def shingle_hashes(wh: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """One hash per run of ``k`` words, in text order; a shorter text is one shingle."""
    n = len(wh)
    if not n:
        return wh
    k = min(k, n)
    h = np.full(n - k + 1, (0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0x100000001B3) ^ wh[i : n - k + 1 + i])
    return h


def shingle_set(text: bytes | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty for null or no word."""
    words = (text or b"").split()
    return np.unique(shingle_hashes(word_hashes(words), k)) if words else np.empty(0, np.uint64)


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, fixed by the salt."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def minhash(h: np.ndarray, mult: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each multiplier the least mixed value over ``h`` (not empty)."""
    out = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), block):
        part = h[at : at + block]
        for i, m in enumerate(mult):
            v = part * m
            v ^= v >> np.uint64(32)
            v *= m
            out[i] = min(out[i], v.min())
    return out
