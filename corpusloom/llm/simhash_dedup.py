"""SimHash near-duplicate documents by a May-Ozerov style nearest-neighbour recursion.

Each text gets a 256-bit SimHash over its distinct folded words. Documents within ``distance`` bits
are copies. The search filters the list of fingerprints by partial weight: on a strip of random
coordinates a fingerprint survives for a random centre if it lies unusually close to it; survivors
recurse into the next strip, and what is left after all strips is a small list, compared by brute
force. Close pairs survive together far more often than chance, and the whole is repeated until a
pair at ``design_distance``, by default the limit itself, is met with probability ``recall`` (closer
pairs with a greater one). The depth and the filter follow from
the number of fingerprints, so that the small lists keep their size (``leaf``) at any scale.

Texts of fewer than MIN_WORDS distinct words, where few words decide all bits, get a hash of their
word set as fingerprint: they equal only texts with the same words.

Defined results. Null and wordless texts are never compared. A null doc_id can't be named, so its
row takes no part. Rows with one doc_id are one document (the fingerprints of all its rows count).
Of each connected group the least doc_id is kept. An empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import DOCUMENT_COLUMNS, components, cut, texts

BITS = tk.SIMHASH_BITS
DISTANCE = 52
MIN_WORDS = 6
LANES = [f"f{k}" for k in range(BITS // 64)]


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, has words)."""
    tok = tk.tokenise(text)
    fp, counts = tk.simhash(tok)
    few = np.flatnonzero((counts > 0) & (counts < MIN_WORDS))
    if len(few):
        rank = np.full(len(counts), -1)
        rank[few] = np.arange(len(few))
        owner = tok.owner
        mine = np.flatnonzero(rank[owner] >= 0)
        h = tk.hash_strings(tk.fold(tok.words), 7)
        key = np.unique(np.stack([rank[owner[mine]].astype(np.uint64), h[tok.codes[mine]]], 1), axis=0)
        sums = np.zeros(len(few), tk.U64)
        np.add.at(sums, key[:, 0].astype(np.int64), tk.mix64(key[:, 1]))
        fp[few] = np.stack([tk.mix64(sums + tk.U64(1000 + k)) for k in range(len(LANES))], 1)
    return fp, counts > 0


@dataclass(frozen=True)
class Plan:
    """Levels of recursion, limit of the partial weight on a strip, centres per level, repetitions."""

    levels: int
    limit: int
    centres: int
    repeats: int
    seed: int = 20

    @property
    def strip(self) -> int:
        return BITS // self.levels

    def coordinates(self, repeat: int) -> np.ndarray:
        return np.random.default_rng([self.seed, repeat]).permutation(BITS)[: self.strip * self.levels].reshape(self.levels, self.strip)

    def centre_signs(self, repeat: int, level: int) -> np.ndarray:
        return np.random.default_rng([self.seed, repeat, level]).choice(np.array([-1, 1], np.float32), (self.strip, self.centres))


def plan(n: int, leaf: int = 1024, design_distance: int = DISTANCE, recall: float = 0.96) -> Plan:
    """Parameters for n fingerprints: lists of about ``leaf``, and enough repetitions for ``recall``."""
    n = max(n, 2 * leaf)
    # few levels need few repetitions; up to leaf / 4 centres a level cost no more than the lists' comparisons
    levels = max(1, math.ceil(math.log(n / leaf) / math.log(max(2, leaf // 4))))
    strip = BITS // levels
    want = (leaf / n) ** (1 / levels)
    tail, limit = 0.0, -1
    while tail + math.comb(strip, limit + 1) / 2**strip <= want:
        limit += 1
        tail += math.comb(strip, limit) / 2**strip
    centres = max(2, round(1 / tail))
    rng = np.random.default_rng(1)
    differ = rng.binomial(strip, design_distance / BITS, 400_000)
    shared, own = rng.binomial(strip - differ, 0.5), rng.binomial(differ, 0.5)
    both = np.mean((shared + own <= limit) & (shared + differ - own <= limit))
    met = (1 - (1 - both) ** centres) ** levels
    return Plan(levels, limit, centres, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def lists_of(fp: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, list id): the small lists that each fingerprint ends in."""
    signs = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    rows, ids = [], []
    for r in range(p.repeats):
        row, path = np.arange(len(fp)), np.full(len(fp), r, np.int64)
        for level, coords in enumerate(p.coordinates(r)):
            # agreement of signs = strip - 2 * partial weight
            close = signs[:, coords] @ p.centre_signs(r, level) >= p.strip - 2 * p.limit
            who, centre = np.nonzero(close)
            count = np.bincount(who, minlength=len(fp))
            first = np.cumsum(count) - count
            times = count[row]
            at = np.repeat(first[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, path = np.repeat(row, times), np.repeat(path, times) * p.centres + centre[at]
        rows.append(row)
        ids.append(tk.mix64(path.view(tk.U64) + tk.U64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64))
    return np.concatenate(rows), np.concatenate(ids)


def groups_within(fp: np.ndarray, distance: int, block: int = 2048) -> np.ndarray:
    """Label of each fingerprint's connected group (the least index in it), by brute force.

    A list of any length: members reached from a pivot leave the list, so a large group of copies
    costs about one pass over it, not the square of its size.
    """
    n = len(fp)
    label = np.arange(n)
    if n <= block:
        near = np.zeros((n, n), np.uint16)
        for k in range(fp.shape[1]):
            near += np.bitwise_count(fp[:, k][:, None] ^ fp[:, k][None, :])
        adjacent = near <= distance
        linked = np.flatnonzero(adjacent.sum(1) > 1)
        sub = adjacent[np.ix_(linked, linked)]
        lab = linked.copy()
        while len(lab):
            new = np.where(sub, lab[None, :], n).min(1)
            if (new == lab).all():
                break
            lab = new
        label[linked] = lab
        return label
    left = np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            for f in frontier:
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                hit[todo] = tk.hamming(fp[left[todo]], fp[f]) <= distance
            frontier, left = left[hit], left[~hit]
            label[frontier] = root
    return label


def near_edges(reps: DataFrame, p: Plan, distance: int) -> DataFrame:
    """Edges (a, b) of doc_ids whose fingerprints are linked within some small list."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                fp = np.stack([part.column(c).to_numpy() for c in LANES], 1).view(tk.U64)
                row, ids = lists_of(fp, p)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(ids), *taken.columns], names=["list", *taken.schema.names])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            key = rows.column("list").to_numpy()
            doc = rows.column("doc_id").to_numpy()
            fp = np.stack([rows.column(c).to_numpy() for c in LANES], 1).view(tk.U64)
            bounds = tk.runs(key)
            a, b = [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    label = groups_within(fp[s:e], distance)
                    linked = np.flatnonzero(label != np.arange(e - s))
                    a.append(doc[s + linked])
                    b.append(doc[s + label[linked]])
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 20_000:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("list").to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
            if end:
                yield flush(rows.slice(0, end))
                held = rows.slice(end).combine_chunks().to_batches()
            size = len(keys) - end
        if held:
            yield flush(pa.Table.from_batches(held))

    lanes = ", ".join(f"{c} long" for c in LANES)
    lists = reps.mapInArrow(spread, f"list long, doc_id long, {lanes}")
    return lists.repartition("list").sortWithinPartitions("list").mapInArrow(brute, "a long, b long")


def copies(docs: DataFrame, distance: int = DISTANCE, design_distance: int | None = None, recall: float = 0.96, leaf: int = 1024) -> DataFrame:
    """doc_id, duplicate_of: each document that goes, with the least doc_id of its group, which stays."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                fp, some = fingerprints(part.column("text"))
                keep = np.flatnonzero(some)
                cols = [part.column("doc_id").take(pa.array(keep)), *(pa.array(fp[keep, k].view(np.int64)) for k in range(len(LANES)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *LANES])

    lanes = ", ".join(f"{c} long" for c in LANES)
    prints = texts(docs).where("doc_id IS NOT NULL").mapInArrow(emit, f"doc_id long, {lanes}")
    prints = cut(prints)
    # a text copied any number of times: partial minima, then a join whose great groups Spark may split
    firsts = cut(prints.groupBy(*LANES).agg(F.min("doc_id").alias("rep")))
    reps = firsts.select(F.col("rep").alias("doc_id"), *LANES)
    p = plan(reps.count(), leaf, distance if design_distance is None else design_distance, recall)
    same = prints.join(firsts, LANES).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = near_edges(reps, p, distance).unionAll(same)
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document columns of docs without the documents that copies() lets go."""
    gone = copies(docs, **options).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
