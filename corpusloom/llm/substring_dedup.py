"""Exact substring dedup over fixed-length token windows.

Every window of ``window`` tokens gets a Rabin-Karp hash (a rolling polynomial over the 64-bit hashes
of its tokens, modulo 2**64). Windows are counted in Spark by (anchor, hash), the anchor of a window
being the least-hashing ``anchor``-gram inside it: equal windows have equal anchors, so counting
within an anchor's group is counting globally, and consecutive windows, which mostly share their
anchor, travel to that group as one row of packed hashes rather than as a row each. A row whose
anchor occurs nowhere else is dropped unread.

Defined results. Tokens are runs of non-whitespace characters, compared exactly (case and
punctuation count, the kind of white space doesn't). A null text counts as empty; a text shorter than
the window has none. A null doc_id can't be named in a result, so such rows are left out. Rows with
one doc_id are one document: a repeated row adds no occurrence. The first occurrence of a window is
the one with the least (doc_id, position); ties are impossible. An empty table gives an empty result,
and columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import texts

WINDOW = 50
ANCHOR = 17
#: Tokens or windows handled at once; a group of more is held packed and handled by shares of the hashes.
PORTION = 1 << 18
U64 = tk.U64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_LOW = (1 << 24) - 1


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``width`` values (mixed)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(values * tk.powers(len(values), U64(_BASE)), dtype=U64)])
    return tk.mix64((prefix[width:] - prefix[:-width]) * tk.powers(n, U64(_INVERSE)))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` items, by doubling."""
    size = 1
    out = a
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def anchored_rows(ids: np.ndarray, text: pa.Array, window: int, anchor: int, portion: int = PORTION) -> Iterator[dict[str, object]]:
    """Columns anchor, doc_id, start and hashes (6 bytes a window) of the texts' windows, of ``portion`` tokens at a time."""
    tok = tk.tokenise(text)
    lengths = np.diff(tok.offsets)
    if not len(tok.codes) or lengths.max() < window:
        return
    words = tk.hash_strings(tok.words, 3)
    last = tok.offsets[1:] - window  # the last window of each text
    for begin in range(0, len(tok.codes), portion):
        values = words[tok.codes[begin : begin + portion + window - 1]]
        # windows that begin here and lie within one document
        low = int(np.searchsorted(tok.offsets[1:], begin, side="right"))
        high = int(np.searchsorted(tok.offsets[:-1], begin + portion))
        first_of = np.maximum(tok.offsets[low:high], begin)
        fits = np.maximum(np.minimum(last[low:high], begin + portion - 1) - first_of + 1, 0)
        if not fits.any():
            continue
        grams = rolling(values, anchor)
        # high bits order the grams, low bits hold the place, so that the least tells where it is (leftmost on ties)
        least = sliding_min((grams & U64(~_LOW % 2**64)) | np.arange(len(grams), dtype=U64), window - anchor + 1)
        hashes = rolling(values, window)
        at = np.repeat(first_of - begin, fits) + np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
        doc = np.repeat(np.arange(low, high), fits)
        place = (least[at] & U64(_LOW)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        bounds = np.append(first, len(at))
        packed = np.ascontiguousarray(hashes[at]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((bounds * 6).astype(np.int32)), pa.py_buffer(packed)])
        start = (at[first] + begin - tok.offsets[doc[first]]).astype(np.int32)
        yield {"anchor": grams[place[first]].view(np.int64), "doc_id": ids[doc[first]], "start": start, "hashes": binary}


@dataclass
class Packed:
    """Rows sorted by anchor, doc_id and start: number of windows of each row, and their packed hashes one after another."""

    anchor: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    raw: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Packed:
        raw, off = tk.string_bytes(batch.column("hashes"))
        return cls(*(batch.column(c).to_numpy() for c in ("anchor", "doc_id", "start")), np.diff(off) // 6, raw)

    @classmethod
    def joined(cls, parts: list[Packed]) -> Packed:
        return parts[0] if len(parts) == 1 else cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))

    def rows(self, begin: int, end: int) -> Packed:
        a, b = (int(self.size[:k].sum()) * 6 for k in (begin, end))
        return Packed(*(v[begin:end].copy() for v in (self.anchor, self.doc, self.start, self.size)), self.raw[a:b].copy())

    def hashes(self, begin: int, end: int) -> np.ndarray:
        wide = np.zeros((end - begin, 8), np.uint8)
        wide[:, :6] = self.raw[begin * 6 : end * 6].reshape(-1, 6)
        return wide.view(U64).ravel()


def _repeated(p: Packed, portion: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Pieces of repeated windows of whole anchor groups. Besides the packed rows it holds a byte a window, and
    what the windows of a share of the hashes need, about ``portion`` of them or those of one hash."""
    anchors = np.diff(tk.runs(p.anchor))
    often = np.repeat(anchors > 1, anchors)
    if not often.all():
        p = Packed(p.anchor[often], p.doc[often], p.start[often], p.size[often], p.raw.reshape(-1, 6)[np.repeat(often, p.size)].ravel())
    if not len(p.anchor):
        return
    ends = np.cumsum(p.size)
    n = int(ends[-1])
    group = np.cumsum(np.concatenate([[0], p.anchor[1:] != p.anchor[:-1]]))
    mark = np.zeros(n, np.uint8)  # 1: first place of a repeated window, 2: a later one
    shares = -(-n // portion)
    for share in range(shares):
        found = []
        for begin in range(0, n, portion):
            h = p.hashes(begin, min(begin + portion, n))
            at = np.flatnonzero(h % U64(shares) == U64(share)) if shares > 1 else np.arange(n)
            found.append((h[at], at + begin))
        h, at = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        if not len(at):
            continue
        row = np.searchsorted(ends, at, side="right")
        pos = p.start[row] + at - (ends[row] - p.size[row])
        doc, g = p.doc[row], group[row]
        order = np.lexsort((pos, doc, h, g))  # equal windows side by side, in order of occurrence
        head = np.concatenate([[True], (g[order[1:]] != g[order[:-1]]) | (h[order[1:]] != h[order[:-1]])])
        first = np.flatnonzero(head)
        of = np.repeat(order[first], np.diff(np.append(first, len(order))))  # the first occurrence of each
        # the same place twice is a repeated row
        later = (doc[order] != doc[of]) | (pos[order] != pos[of])
        repeated = np.repeat(np.logical_or.reduceat(later, first), np.diff(np.append(first, len(order))))
        mark[at[order]] = np.where(later, 2, repeated)
    for begin in range(0, n, portion):  # pieces that a border cuts are joined with the others
        at = begin + np.flatnonzero(mark[begin : begin + portion])
        if not len(at):
            continue
        row = np.searchsorted(ends, at, side="right")
        d, pos, r = p.doc[row], p.start[row] + at - (ends[row] - p.size[row]), mark[at] == 2
        order = np.lexsort((pos, r, d))
        d, pos, r = d[order], pos[order], r[order]
        a = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (pos[1:] > pos[:-1] + 1)]))
        b = np.append(a[1:], len(d)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(d[a], pa.int64()), pa.array(r[a], pa.bool_()), pa.array(pos[a].astype(np.int32)), pa.array(pos[b].astype(np.int32))], names=["doc_id", "removable", "a", "b"])


def pieces_of(batches: Iterable[pa.RecordBatch], portion: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Pieces of repeated windows from rows sorted by anchor, doc_id and start; about ``portion`` windows or one group at a time."""
    held: list[Packed] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(Packed.of(batch))
        size += len(held[-1].raw) // 6
        if size < portion or held[0].anchor[0] == held[-1].anchor[-1]:  # else one group goes on
            continue
        rows = Packed.joined(held)
        cut = int(np.searchsorted(rows.anchor, rows.anchor[-1]))  # the last group may go on
        held = [rows.rows(cut, len(rows.anchor))]
        size = len(held[0].raw) // 6
        rows = rows.rows(0, cut)
        yield from _repeated(rows, portion)
    if held:
        rows = Packed.joined(held)
        held.clear()
        yield from _repeated(rows, portion)


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start_token, end_token (exclusive), removable: maximal intervals of repeated windows.

    Intervals with removable = true join the windows that occurred before (removing them leaves the
    first occurrence of each); those with removable = false join the first occurrences themselves.
    """
    if not 0 < anchor <= window:
        raise ValueError("anchor must be between 1 and window")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                for cols in anchored_rows(part.column("doc_id").to_numpy(), part.column("text"), window, anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols.values()], names=list(cols))

    rows = texts(docs).where("doc_id IS NOT NULL").mapInArrow(emit, "anchor long, doc_id long, start int, hashes binary")
    pieces = rows.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(pieces_of, "doc_id long, removable boolean, a int, b int")
    w = Window.partitionBy("doc_id", "removable").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a gap between starts of windows keeps intervals apart unless the windows themselves overlap or touch
    island = F.sum(F.when(F.col("a") <= F.col("reach") + window, 0).otherwise(1)).over(w)
    merged = pieces.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "removable", "island").agg(F.min("a").cast("long").alias("start_token"), (F.max("b") + window).cast("long").alias("end_token"))
    return merged.select("doc_id", "start_token", "end_token", "removable")
