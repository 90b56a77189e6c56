"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Templates are parted by length; for templates of up to L words a text is cut into windows of
2L shingles that start every L shingles, so any run of L words lies whole within one.  A
window that holds a share t of a template of q shingles has a Jaccard similarity of at least
s = t*q / (2L + (1-t)*q) with it.  Each of b bands is one
minimum hash; b is the least number for which 1-(1-s)^b reaches ``COLLISION``.  A template
that shares a band with any window is then checked by the exact containment of its shingles
in that window.  A window without any template's shingle can agree in no band, so bands are
computed for the others alone.  One pass, no shuffle: no line or license is a hot key.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import id_text, map_batches, utf8
from .text import SHINGLE_WORDS, seeds, shingle_hashes, word_hashes

CONTAINMENT = 0.8
COLLISION = 0.9999
SCHEMA = "doc_id long, license string, first_word long, n_words long, n_shared long, n_template long, containment double"

#: Well-known notices, as their licenses give them: fixed values.
TEMPLATES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def bands_for(q: int, words: int, share: float) -> int:
    """Bands with which a window of 2*words shingles collides with a template of q shingles inside it."""
    s = share * q / (2 * words + (1 - share) * q)
    return max(1, math.ceil(math.log(1 - COLLISION) / math.log(1 - min(s, 1 - 1e-9))))


def window_words(n: int, k: int = SHINGLE_WORDS) -> int:
    """The length class of a template of n words; its windows have twice as many shingles."""
    return max(min(k, n), 1 << (n - 1).bit_length())


@dataclass
class _Class:
    words: int
    k: int
    shingles: np.ndarray
    mult: np.ndarray
    keys: list[dict[int, list[int]]]


@dataclass
class Index:
    names: list[str]
    sets: list[np.ndarray]
    orders: list[dict[int, list[int]]]
    classes: list[_Class]
    share: float


def build(templates: dict[str, str], share: float = CONTAINMENT, k: int = SHINGLE_WORDS) -> Index:
    """The bands of all templates; a template under k words is one shingle of its own length."""
    names, sets, orders, parts = [], [], [], defaultdict(list)
    for name, text in sorted(templates.items()):
        wh = word_hashes(text.encode().split(), strip=True)
        wh = wh[wh != 0]
        if len(wh):
            own = min(k, len(wh))
            parts[(own, window_words(len(wh), k))].append(len(names))
            names.append(name)
            of, at = shingle_hashes(wh, own), defaultdict(list)
            for p, h in enumerate(of.tolist()):
                at[h].append(p)
            sets.append(np.unique(of))
            orders.append(dict(at))
    classes = []
    for (own, words), members in sorted(parts.items()):
        mult = seeds(max(bands_for(len(sets[i]), words, share) for i in members), salt=words)
        keys = []
        for m in mult:
            of = defaultdict(list)
            for i in members:
                of[int(_mixed(sets[i], m).min())].append(i)
            keys.append(dict(of))
        classes.append(_Class(words, own, np.unique(np.concatenate([sets[i] for i in members])), mult, keys))
    return Index(names, sets, orders, classes, share)


def _mixed(h: np.ndarray, m: np.uint64) -> np.ndarray:
    v = h * m
    v ^= v >> np.uint64(32)
    v *= m
    return v


def _runs(hashes: list[int], order: dict[int, list[int]]) -> list[list[int]]:
    """A window's hits of a template, parted where it begins again: where a hit has no place behind that of the hit before."""
    out: list[list[int]] = [[]]
    last = -1
    for i, h in enumerate(hashes):
        p = next((p for p in order[h] if p > last), None)
        if p is None:
            out.append([])
            p = order[h][0]
        out[-1].append(i)
        last = p
    return out


def scan_text(index: Index, text: bytes | None) -> list[tuple[str, int, int, int, int]]:
    """(license, first word, words, shared, template's shingles) of every occurrence: of those that overlap, the best."""
    words = (text or b"").split()
    if not words:
        return []
    wh, found = word_hashes(words, strip=True), defaultdict(list)
    place = np.flatnonzero(wh)  # of words that are not marks alone
    wh = wh[place]
    shingles: dict[int, np.ndarray] = {}
    for c in index.classes:
        if len(wh) < c.k:
            continue
        if c.k not in shingles:
            shingles[c.k] = shingle_hashes(wh, c.k)
        h = shingles[c.k]
        near = np.searchsorted(c.shingles, h)
        near[near == len(c.shingles)] = 0
        hit = np.flatnonzero(c.shingles[near] == h) // c.words
        seen = set()
        for at in np.unique(np.concatenate([hit, np.maximum(hit, 1) - 1])).tolist():
            window = h[at * c.words : (at + 2) * c.words]
            low = _mixed(window[:, None], c.mult[None, :]).min(axis=0)
            seen.update((at, i) for value, keys in zip(low.tolist(), c.keys) for i in keys.get(value, ()))
        for at, i in seen:
            window = h[at * c.words : (at + 2) * c.words]
            inside = np.isin(window, index.sets[i])
            where, hits = (np.flatnonzero(inside) + at * c.words).tolist(), window[inside].tolist()
            least = index.share * len(index.sets[i]) - 1e-9
            if len(set(hits)) < least:
                continue
            # Occurrences side by side are told apart; where none has enough by itself, as when parts were moved, the window is one.
            runs = [r for r in _runs(hits, index.orders[i]) if len({hits[j] for j in r}) >= least] or [list(range(len(hits)))]
            for r in runs:
                found[i].append((-len({hits[j] for j in r}), int(place[where[r[0]]]), int(place[where[r[-1]] + c.k - 1]) + 1))
    out = []
    for i, windows in found.items():
        taken: list[tuple[int, int]] = []
        for shared, first, stop in sorted(windows):
            if all(stop <= a or b <= first for a, b in taken):
                taken.append((first, stop))
                out.append((index.names[i], first, stop - first, -shared, len(index.sets[i])))
    return sorted(out)


def _scan(it, index: Index):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for b in it:
        rows = [(d, *r, r[3] / r[4]) for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1))) for r in scan_text(index, t)]
        cols = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string()] + [pa.int64()] * 4 + [pa.float64()])], names=names)


def scan(documents: DataFrame, templates: dict[str, str] | None = None, share: float = CONTAINMENT, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document row and occurrence of a license template in it, with its place in the text's words.

    Words are compared without case (A-Z) and without marks at their ends; words of marks
    alone, as those that lead the lines of a comment, are passed over.  An occurrence ends where
    the template begins again, so notices in a row are told apart; of places of one template
    that overlap the best counts, of equally good ones the first.  Whole texts are
    read, however long.  Null and empty texts have no license; repeated rows are
    scanned each by itself; templates without a word are left out; other columns are not
    read; an empty table gives an empty result.  ``templates`` is a parameter of the call and
    goes to every task, so it is meant for hundreds of notices.
    """
    index = build(TEMPLATES if templates is None else templates, share, k)
    return map_batches(id_text(documents), lambda it: _scan(it, index), SCHEMA, ("stripped words",))
