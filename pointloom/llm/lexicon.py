"""A minimal acyclic transducer from words to token ids, as arrays that all workers map into memory.

Words are read by code points.  States with the same continuations are one, so words share their
ends as well as their beginnings.  Each arc has a number as output; the numbers along a word add
up to its place in the table of id sequences.  Arcs lie in one array by (the state's base + the
code point's label), so a step is a look-up, and very many words walk side by side.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .files import local_path, open_in, open_out

#: Code points, and one number beyond them.
POINTS = 0x110001


@dataclass
class Lexicon:
    """``labels``: of each code point, 0 where no word has it.  State 0 is the start."""

    labels: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray
    id_starts: np.ndarray
    ids: np.ndarray
    classes: np.ndarray
    longest: np.ndarray

    @property
    def n_words(self) -> int:
        return len(self.id_starts) - 1

    @property
    def n_states(self) -> int:
        return len(self.base)

    def find(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word ``points[start:end]`` in the table of ids, or -1."""
        labels = self.labels[points]
        out = np.full(len(starts), -1, np.int64)
        at = np.flatnonzero(ends - starts <= int(self.longest[0]))
        place, end = starts[at], ends[at]
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        while len(at):
            slot = self.base[state] + labels[place]
            there = self.owner[slot] == state
            if not there.all():
                at, place, end, slot, total = at[there], place[there], end[there], slot[there], total[there]
            total = total + self.output[slot]
            state = self.target[slot]
            place = place + 1
            over = place == end
            if over.any():
                done = over & self.final[state]
                out[at[done]] = total[done]
                on = ~over
                at, place, end, state, total = at[on], place[on], end[on], state[on], total[on]
        return out


def _states(words: list[str]) -> tuple[list[dict[str, int]], list[bool], int]:
    """The minimal automaton of sorted distinct words, built word by word: arcs, final states and the start."""
    arcs: list[dict[str, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}

    def settled(node: dict[str, int], ends: bool) -> int:
        key = (ends, *node.items())
        found = known.get(key)
        if found is None:
            found = known[key] = len(arcs)
            arcs.append(node)
            final.append(ends)
        return found

    path: list[list] = [[{}, False]]  # the last word's nodes, which may still grow
    last = ""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            node, ends = path.pop()
            path[-1][0][last[len(path) - 1]] = settled(node, ends)
        path += [[{}, False] for _ in w[common:]]
        path[-1][1] = True
        last = w
    while len(path) > 1:
        node, ends = path.pop()
        path[-1][0][last[len(path) - 1]] = settled(node, ends)
    return arcs, final, settled(*path[0])


def _placed(wanted: list[np.ndarray], n_labels: int) -> tuple[np.ndarray, int]:
    """Bases such that the slots base + label of all states differ; the last number is how many slots there are."""
    n = sum(map(len, wanted))
    free = np.ones(2 * n + 4 * n_labels + 64, bool)
    free[:n_labels] = False  # so that no base is negative
    base = np.zeros(len(wanted), np.int64)
    order = sorted(range(len(wanted)), key=lambda i: -len(wanted[i]))
    begin, degree = n_labels, 0
    single = [i for i in order if len(wanted[i]) == 1]
    for i in order:
        labels = wanted[i]
        if len(labels) < 2:
            break
        if len(labels) != degree:
            begin, degree = n_labels, len(labels)
        at, step = begin, 512
        while True:
            while at + step + n_labels >= len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            fits = free[at : at + step].copy()
            for x in labels[1:] - labels[0]:
                fits &= free[at + x : at + step + x]
            found = int(fits.argmax())
            if fits[found]:
                break
            at += step
        base[i] = at + found - labels[0]
        free[base[i] + labels] = False
        begin = at  # what is left before is for states of fewer arcs
    slots = np.flatnonzero(free)
    if len(slots) < len(single):
        slots = np.concatenate([slots, len(free) + np.arange(len(single) - len(slots))])
    for i, slot in zip(single, slots.tolist()):
        base[i] = slot - wanted[i][0]
    used = max((int(b + w[-1]) for b, w in zip(base, wanted) if len(w)), default=0)
    return base, max(used + 1, int(base.max(initial=0)) + n_labels)


def build(words: dict[str, list[int]], classes: np.ndarray) -> Lexicon:
    """The transducer of words and their ids; ``classes`` is kept beside it for those who cut texts into words.

    The empty word is left out.  Without words it finds nothing.
    """
    ordered = sorted(w for w in words if w)
    arcs, final, start = _states(ordered)
    letters = sorted({c for w in ordered for c in w})
    labels = np.zeros(POINTS, np.uint16 if len(letters) < 1 << 16 else np.uint32)
    number = {c: i for i, c in enumerate(letters, 1)}
    for c, i in number.items():
        labels[ord(c)] = i
    order = [start, *(i for i in range(len(arcs)) if i != start)]  # the start is state 0
    place = np.empty(len(arcs), np.int64)
    place[order] = np.arange(len(order))
    wanted = [np.fromiter((number[c] for c in arcs[i]), np.int64, len(arcs[i])) for i in order]
    base, size = _placed(wanted, len(letters) + 1)
    owner, target, output = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    below = np.zeros(len(arcs), np.int64)  # words from a state on; states come after those that they lead to
    for i in range(len(arcs)):
        n, at = int(final[i]), place[i]
        for c, t in arcs[i].items():
            slot = base[at] + number[c]
            owner[slot], target[slot], output[slot] = at, place[t], n
            n += below[t]
        below[i] = n
    got = [words[w] for w in ordered]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)]).astype(np.int64)
    ids = np.fromiter((x for g in got for x in g), np.uint32, int(starts[-1]))
    ends = np.array([final[i] for i in order], bool)
    return Lexicon(labels, base.astype(np.int32), owner, target, output, ends, starts, ids, classes, np.array([max(map(len, ordered), default=0)], np.int64))


_HEAD = 4096


def save(lexicon: Lexicon, uri: str) -> None:
    """All arrays in one file, each from a multiple of 64 bytes on, behind a head that names them."""
    head, at = [], _HEAD
    arrays = [(f.name, np.ascontiguousarray(getattr(lexicon, f.name))) for f in fields(Lexicon)]
    for name, a in arrays:
        head.append(f"{name} {a.dtype.str} {len(a)} {at}")
        at += -(-a.nbytes // 64) * 64
    with open_out(uri) as f:
        f.write("\n".join(head).encode().ljust(_HEAD))
        for _, a in arrays:
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 64))


@lru_cache(2)
def load(uri: str) -> Lexicon:
    """A saved lexicon; on a mounted folder its pages are mapped and shared by all workers of a machine, else it is read once a worker."""
    path = local_path(uri)
    if path is not None:
        data = np.frombuffer(pa.memory_map(path).read_buffer(), np.uint8)
    else:
        with open_in(uri) as f:
            data = np.frombuffer(f.read(), np.uint8)
    parts = {}
    for line in io.StringIO(data[:_HEAD].tobytes().decode().rstrip()):
        name, kind, n, at = line.split()
        kind = np.dtype(kind)
        parts[name] = data[int(at) : int(at) + int(n) * kind.itemsize].view(kind)
    return Lexicon(**parts)
