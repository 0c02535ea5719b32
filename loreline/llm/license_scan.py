"""License scan: MinHash bands over overlapping text windows retrieve templates; exact shingle containment verifies them.

Templates are whole license texts (the files in ``licenses``) and the notices by which a work names its license. Texts are cut into
overlapping windows, one width for each class of template lengths: a class of width w holds templates of w / 1.25 to w words, its windows
have 3 w / 2 words and begin every w / 2, so a template lies whole in some window. A window and a template share a band if their MinHash
values agree in all ``ROWS`` rows of it. A template of which the share ``CONTAINMENT`` stands in its window has a Jaccard similarity of at
least 0.38 with it, so each of the ``BANDS`` bands of two rows is shared with probability 0.148 or more, and all are missed with
probability below 0.0005. Candidates are verified exactly: at least ``containment`` of the template's shingles stand in the window and the
halves of the windows beside it.

Windows with fewer shingles of the class's templates than ``containment`` of the smallest one's contain none; they are not hashed. One map
over the texts without a shuffle; templates are a fixed, broadcast table.

Defined cases: words are runs of letters and digits, ASCII case folded; shingles are ``SHINGLE`` words; null or empty texts match nothing;
null ids pass through; repeated rows each give their matches; several matches of a license in one text count, the best is
reported (by shingles times containment; ties: the first), with the words from its first to its last shingle; a match of which most
positions belong to better ones is left out; a template of fewer words
than a shingle is left out; very long texts are mapped alone; other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm import _text as X
from loreline.llm._frames import col

SHINGLE, BANDS, ROWS, CONTAINMENT = 2, 48, 2, 0.8
U = X.U
_SECOND = U(0x9FB21C651E98DF25)

# Opening lines and notices of public licenses.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def templates() -> list[tuple[str, str]]:
    """(license, text): the notices, and the whole texts by file name."""
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD"}
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return NOTICES + [(names.get(f.stem, f.stem), f.read_text(encoding="utf-8", errors="replace")) for f in files]


def width_of(words: int) -> int:
    """The width of a template's class: 4, and each time a quarter more."""
    w = 4
    while w < words:
        w = -(-5 * w // 4)
    return w


def bands_of(low: np.ndarray) -> np.ndarray:
    """(bands, n) values of bands from (bands * rows, n) MinHash values."""
    out = np.zeros((BANDS, low.shape[1]), U)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = X.mix(out * _SECOND + low[r::ROWS])
    return out


class Index:
    """Templates by class: shingle sets and band values."""

    def __init__(self, given: list[tuple[str, str]], shingle: int = SHINGLE):
        self.shingle = shingle
        self.names, self.sets, self.words, self.heads = [], [], [], []
        for name, text in given:
            data, offsets = X.bytes_of(pa.array([text], pa.large_string()))
            hashes = X.hash_words(data, X.split_words(data, offsets, X.NOT_ALNUM), X.LOWER)
            if len(hashes) >= shingle:
                self.names.append(name)
                rolled = X.mix(X.roll(hashes, shingle))
                self.sets.append(np.unique(rolled))
                self.heads.append(rolled[0])
                self.words.append(len(hashes))
        self.salts = X.mix(np.arange(1, BANDS * ROWS + 1, dtype=U))
        width = np.array([width_of(n) for n in self.words], np.int64)
        self.classes = []
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            value = bands_of(np.stack([[X.mix(self.sets[t] ^ salt).min() for t in own] for salt in self.salts]).astype(U))
            self.classes.append((int(w), own, value, np.unique(np.concatenate([self.sets[t] for t in own])), min(len(self.sets[t]) for t in own)))
        self.every = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, U)


def scan(index: Index, data: np.ndarray, offsets: np.ndarray, containment: float) -> list[tuple]:
    """(text, license, share of the template's shingles, first word, words) for the best match of each license in each text."""
    words = X.split_words(data, offsets, X.NOT_ALNUM)
    hashes = X.hash_words(data, words, X.LOWER)
    m = len(hashes) - index.shingle + 1
    if m <= 0 or not len(index.every):
        return []
    sh = X.mix(X.roll(hashes, index.shingle))
    inside = words.text[:m] == words.text[index.shingle - 1:]
    at = np.minimum(np.searchsorted(index.every, sh), len(index.every) - 1)
    known = np.flatnonzero(inside & (index.every[at] == sh))
    matches: dict[int, set[tuple]] = {}
    for width, own, values, shingles, least in index.classes:
        mine = known[np.isin(sh[known], shingles)]
        if not len(mine):
            continue
        step = max(1, width // 2)
        first = words.first[words.text[mine]]
        last = (mine - first) // step  # windows that reach a shingle begin at most width + step words before it
        back = np.arange((width + step) // step + 1)
        start = np.unique((first[:, None] + np.maximum(last[:, None] - back, 0) * step).ravel())
        ends = words.first[words.text[start] + 1]
        stop = np.minimum(start + width + step, ends) - index.shingle + 1
        told = np.searchsorted(mine, stop) - np.searchsorted(mine, start)
        good = (stop > start) & (told >= containment * least)
        start, stop, ends = start[good], stop[good], ends[good]
        if not len(start):
            continue
        size = stop - start
        begin = np.cumsum(size) - size
        content = sh[np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(begin, size)]
        low = np.stack([np.minimum.reduceat(X.mix(content ^ salt), begin) for salt in index.salts])
        shared = (bands_of(low)[:, :, None] == values[:, None, :]).any(axis=0)
        for w, t in zip(*np.nonzero(shared)):
            text = int(words.text[start[w]])
            lo, hi = max(start[w] - step, words.first[text]), min(stop[w] + step, ends[w] - index.shingle + 1)
            n, begins, ends_at = _place(sh[lo:hi], index.sets[own[t]], index.heads[own[t]], index.words[own[t]] - index.shingle + 1, containment)
            if n:
                whole = len(index.sets[own[t]])
                matches.setdefault(text, set()).add((-n * n / whole, -n / whole, lo + begins, lo + ends_at, int(own[t])))
    return [row for text, rows in sorted(matches.items()) for row in _settle(index, sh, text, int(words.first[text]), sorted(rows))]


def _place(sh: np.ndarray, template: np.ndarray, head: np.uint64, size: int, containment: float) -> tuple[int, int, int]:
    """(different shingles of the template, first, last) of the stretch in which it stands; 0 if it does not.

    The stretch is the ``size`` positions that hold most shingles of it (its own beginning decides between equals), cut to the first and
    last one; a quarter more positions, or all, where these hold too few, as in a text with words put in.
    """
    stands = np.isin(sh, template)
    for room in (size, size + -(-size // 4), len(sh)):
        room = min(room, len(sh))
        total = np.concatenate([[0], np.cumsum(stands)])
        held = 2 * (total[room:] - total[:len(total) - room]) + (sh[:len(sh) - room + 1] == head)
        at = int(held.argmax())
        own = at + np.flatnonzero(stands[at:at + room])
        n = len(np.unique(sh[own]))
        if n >= containment * len(template):
            return n, int(own[0]), int(own[-1])
    return 0, 0, 0


def _settle(index: Index, sh: np.ndarray, text: int, first: int, ranked: list[tuple]) -> list[tuple]:
    """The best match of each license, without matches that are explained by better ones: most of their positions stand in such too."""
    rank = {key: k + 1 for k, key in enumerate(sorted({r[:2] for r in ranked}))}
    low, high = min(r[2] for r in ranked), max(r[3] for r in ranked) + 1
    taken = np.zeros(high - low, np.int32)  # at each position the rank of the best match of which it is a part
    best: dict[str, tuple] = {}
    for worth, share, begins, ends, t in ranked:
        own = begins - low + np.flatnonzero(np.isin(sh[begins:ends + 1], index.sets[t]))
        place, mine = taken[own], rank[worth, share]
        if 2 * int(((place > 0) & (place < mine)).sum()) > len(own):
            continue
        taken[own[place == 0]] = mine
        best.setdefault(index.names[t], (text, index.names[t], -share, int(begins - first), int(ends - begins + index.shingle)))
    return [best[name] for name in sorted(best)]


def scan_licenses(docs: DataFrame, given: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Licenses that a text names: id, license, containment, start_word, n_words."""
    index = Index(templates() if given is None else given)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # the size of the template list

    def run(batches):
        for b in X.slices(batches, "text"):
            found = scan(shared.value, *X.bytes_of(b.column("text")), containment)
            yield pa.record_batch({"id": b.column("id").take(pa.array([f[0] for f in found], pa.int64())), "license": pa.array([f[1] for f in found], pa.string()), "containment": pa.array([f[2] for f in found], pa.float64()), "start_word": pa.array([f[3] for f in found], pa.int64()), "n_words": pa.array([f[4] for f in found], pa.int64())})

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, license string, containment double, start_word long, n_words long").withColumnRenamed("id", id_col)
