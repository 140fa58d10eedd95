"""Licence scan: MinHash bands retrieve templates for text windows, exact containment verifies them.

Windows as long as a template (one length per distinct template length, overlapping by 7/8) get
MinHash signatures over their word-pair shingles; a window and a template that agree in a band of
``ROWS`` values are a candidate, which is verified by the exact share of the template's shingles in
the window widened by one step to either side. With BANDS bands of ROWS rows a window of Jaccard
similarity j is retrieved with probability 1 - (1 - j**ROWS)**BANDS: the widest misalignment (1/16 of
the length) and a containment of CONTAINMENT leave j >= 0.6, hence more than 0.999999. Windows that
hold fewer template shingles than any verification needs are not signed; no match is lost by that.

An index of the templates' bands tells which templates a window meets, so that the work doesn't grow
with their number. They are a fixed list, so all of it is one map over the documents.

Tokens of punctuation alone (comment marks at the beginning of lines, say) are passed over, on both
sides; places and lengths in the result count them. Defined results. A null text counts as empty; a
text shorter than a template is one window. Rows are scanned one by one: a repeated row repeats its matches, and a null doc_id is carried through. Of
templates on overlapping tokens the one of greater containment is reported (then the longer one,
then the first in the list), at the place where it is contained best, without the widening if several
are equal, and the first of those. An empty table
gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textkit as tk
from .spark_util import texts

BANDS, ROWS = 32, 2
CONTAINMENT = 0.8

#: (template, licence, text). Short grants and notices, as they stand in files under the licence.
TEMPLATES = (
    ("apache-2-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit-short", "MIT", "Released under the MIT License"),
    ("mit-licensed", "MIT", "Licensed under the MIT License"),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-short", "BSD", "Use of this source code is governed by a BSD-style license"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3-short", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2-short", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-grant", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-short", "LGPL", "This library is licensed under the GNU Lesser General Public License"),
    ("agpl-short", "AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4", "CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4", "CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4-long", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "proprietary", "All rights reserved"),
)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of pairs of neighbouring folded words, word offsets, token number of each word). Pair k starts at word k."""
    tok = tk.tokenise(text)
    folded = tk.fold(tok.words)
    is_word = (pc.utf8_length(folded).to_numpy(zero_copy_only=False) > 0)[tok.codes] if len(tok.codes) else np.zeros(0, bool)
    offsets = np.concatenate([[0], np.cumsum(is_word)])[tok.offsets]
    place = (np.arange(len(tok.codes)) - tok.offsets[:-1][tok.owner])[is_word]
    values = tk.hash_strings(folded, 9)[tok.codes[is_word]] if len(tok.codes) else np.zeros(0, tk.U64)
    if len(values) < 2:
        return np.zeros(len(values), tk.U64), offsets, place
    return np.append(tk.mix64(values[:-1] * tk.U64(3) + values[1:]), tk.U64(0)), offsets, place


def signatures(rows: np.ndarray) -> np.ndarray:
    """Band keys (n, BANDS) of equally long shingle rows (n, k)."""
    out = np.empty((len(rows), BANDS), tk.U64)
    for b in range(BANDS):
        key = np.zeros(len(rows), tk.U64)
        for r in range(ROWS):
            key = tk.mix64(key + tk.mix64(rows ^ tk.U64((b * ROWS + r + 1) * 0xA24BAED4963EE407 % 2**64)).min(1))
        out[:, b] = key
    return out


class Templates:
    def __init__(self, listed: tuple[tuple[str, str, str], ...]):
        self.listed = listed
        h, off, _ = shingles(pa.array([t for _, _, t in listed], pa.string()))
        self.length = np.diff(off)
        if self.length.min(initial=2) < 2:
            raise ValueError("a template needs two words")
        self.sets = [np.unique(h[a : b - 1]) for a, b in zip(off[:-1], off[1:], strict=True)]
        self.all = np.unique(np.concatenate(self.sets))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.length):
            mine = np.flatnonzero(self.length == n)
            bands = np.concatenate([signatures(h[off[i] : off[i + 1] - 1][None])[0] for i in mine])
            order = np.argsort(bands, kind="stable")
            self.by_length[int(n)] = (mine, bands[order], np.repeat(mine, BANDS)[order])

    def met(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Distinct (row, template of n words) where a row of band keys has a band of the template."""
        _, bands, template = self.by_length[n]
        flat = keys.ravel()
        lo, hi = np.searchsorted(bands, flat), np.searchsorted(bands, flat, side="right")
        some = np.flatnonzero(hi > lo)
        size = (hi - lo)[some]
        at = np.repeat(lo[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.unique(np.stack([np.repeat(some // BANDS, size), template[at]], 1), axis=0)


@lru_cache(maxsize=4)
def compiled(listed: tuple[tuple[str, str, str], ...]) -> Templates:
    return Templates(listed)


def scan_texts(text: pa.Array, listed: tuple[tuple[str, str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> list[tuple[int, int, float, int, int]]:
    """(text, template, containment, first token, tokens) of the verified and best matches."""
    t = compiled(listed)
    h, off, place = shingles(text)
    if len(h) < 2:
        return []
    at = np.minimum(np.searchsorted(t.all, h), len(t.all) - 1)
    known = t.all[at] == h
    known[off[1:][np.diff(off) > 0] - 1] = False  # the pair that would reach into the next text
    total = np.concatenate([[0], np.cumsum(known)])
    near = np.flatnonzero(known)
    found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for n, (mine, *_) in t.by_length.items():
        step = max(1, n // 8)
        need = int(np.ceil(containment * min(len(t.sets[i]) for i in mine) - 1e-9))
        # window starts on the grid of each text that can hold a known pair
        owner = np.searchsorted(off, near, side="right") - 1
        base = off[owner]
        lo, hi = np.maximum(near - n + 2 - base, 0), near - base
        grid_lo = -(-lo // step)
        count = np.maximum(hi // step - grid_lo + 1, 0)
        k = np.repeat(grid_lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.unique(np.repeat(base, count) + k * step)
        who = np.searchsorted(off, starts, side="right") - 1
        # the last window of a text ends with it, whatever the grid
        last = np.maximum(off[who + 1] - n, off[who])
        starts = np.unique(np.minimum(starts, last))
        who = np.searchsorted(off, starts, side="right") - 1
        left, right = np.maximum(starts - step, off[who]), np.minimum(starts + n + step, off[who + 1])
        enough = (total[right - 1] - total[left] >= need) & (right - left >= 2)
        starts, who, left, right = (x[enough] for x in (starts, who, left, right))
        size = np.minimum(n, off[who + 1] - starts)  # a shorter text is one window
        for m in np.unique(size):
            same = np.flatnonzero(size == m)
            for c in range(0, len(same), 2048):
                some = same[c : c + 2048]
                keys = signatures(h[starts[some][:, None] + np.arange(m - 1)])
                for i, j in t.met(n, keys):
                    i = some[i]
                    share = len(np.intersect1d(h[left[i] : right[i] - 1], t.sets[j])) / len(t.sets[j])
                    if share >= containment - 1e-9:
                        tight = len(np.intersect1d(h[starts[i] : starts[i] + m - 1], t.sets[j]))
                        key, new = (int(who[i]), int(j)), (-share, -tight, int(starts[i] - off[who[i]]), int(m))
                        if key not in found or new < found[key]:
                            found[key] = new
    per_text: dict[int, list] = {}
    for (i, j), (share, _, start, n) in found.items():
        per_text.setdefault(i, []).append((share, -n, j, start))
    out = []
    for i, got in sorted(per_text.items()):
        taken: list[tuple[int, int]] = []
        for share, n, j, start in sorted(got):
            if all(start >= e or start - n <= s for s, e in taken):
                taken.append((start, start - n))
                first, last = place[off[i] + start], place[off[i] + start - n - 1]
                out.append((i, j, -share, int(first), int(last - first + 1)))
    return out


def scan(docs: DataFrame, listed: tuple[tuple[str, str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, license, containment, start_token, n_tokens: a row per document and template found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                got = scan_texts(part.column("text"), listed, containment)
                text, which, share, start, n = zip(*got, strict=True) if got else ((), (), (), (), ())
                cols = [part.column("doc_id").take(pa.array(text, pa.int64())), pa.array([listed[j][0] for j in which], pa.string()), pa.array([listed[j][1] for j in which], pa.string()), pa.array(share, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "template", "license", "containment", "start_token", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, template string, license string, containment double, start_token long, n_tokens long")
