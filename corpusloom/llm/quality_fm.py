"""Factorisation-machine classifier of document quality and toxicity, a head each.

Features of a document: its distinct folded words hashed into N_WORDS buckets (each 1/sqrt(number of
words)), and one-hot ranges of structure statistics and the metadata column lang (each 1). With
factors v the score is  w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2],
linear in the number of features.

Training reads at most ``max_labelled`` labelled documents (the ones whose doc_id hashes lowest; the
bound is a parameter of ``fit``) and fits on the driver; scoring is one map over all documents.

Defined results: a null text is an empty text, a null or unknown lang its own bucket; a document
without words is scored on its statistics alone. Each input row gives one output row, so repeated
rows repeat and an empty table gives an empty result; a null doc_id is carried through. Labels that
are null, or whose document is missing, are not used (a row may label one head alone); a head without
any usable label scores 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import texts

N_WORDS = 1 << 17
N_STATS = 1 << 10
K = 6
HEADS = ("quality", "toxic")
#: Heads whose rare class weighs as much as the other one.
BALANCED = ("toxic",)


def features(text: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, x, offsets): sparse rows, codes below N_WORDS for words, N_STATS further ones for the rest."""
    tok = tk.tokenise(text)
    n = len(tok.offsets) - 1
    owner = tok.owner
    folded = tk.fold(tok.words)
    bucket = (tk.hash_strings(folded, 1) % tk.U64(N_WORDS)).astype(np.int64)
    blank = pc.equal(folded, "").to_numpy(zero_copy_only=False)
    o, c, counts = tk.distinct_pairs(owner, np.where(blank, N_WORDS, bucket)[tok.codes], N_WORDS + 1)
    word = c < N_WORDS
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[word], counts[word])
    o, c = o[word], c[word]
    distinct = np.bincount(o, minlength=n)

    raw, off = tk.string_bytes(tok.words)
    size = pc.utf8_length(tok.words).to_numpy(zero_copy_only=False)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    upper = (raw >= 65) & (raw <= 90)
    digit = (raw >= 48) & (raw <= 57)

    def per_doc(word_values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=word_values[tok.codes], minlength=n)

    words = np.diff(tok.offsets)
    chars, bytes_ = per_doc(size), per_doc(np.diff(off))
    n_letters, n_upper, n_digit = (per_doc(tk.segment_sum(x, off, np.int64)) for x in (letter, upper, digit))
    same = np.bincount(owner[1:], weights=(tok.codes[1:] == tok.codes[:-1]) & (owner[1:] == owner[:-1]), minlength=n) if len(owner) > 1 else np.zeros(n)
    lines = pc.count_substring(tk.as_string(text), "\n").to_numpy(zero_copy_only=False) + 1
    some, bytes_ = np.maximum(words, 1), np.maximum(bytes_, 1)
    stats = [
        np.log2(words + 1),
        np.minimum(2 * chars / some, 40),
        20 * n_letters / bytes_,
        20 * n_upper / np.maximum(n_letters, 1),
        20 * n_digit / bytes_,
        20 * per_doc(blank.astype(np.int64)) / some,
        20 * distinct / some,
        20 * top / some,
        20 * same / some,
        np.log2(lines),
        np.minimum(4 * np.log2(some / lines), 60),
    ]
    language = (tk.hash_strings(tk.as_string(lang), 2) % tk.U64(64)).astype(np.int64)
    rest = np.stack([64 * k + np.clip(np.floor(s), 0, 63).astype(np.int64) for k, s in enumerate([*stats, language])], 1)
    m = rest.shape[1]
    code = np.concatenate([c, (N_WORDS + rest).ravel()])
    x = np.concatenate([1 / np.sqrt(distinct[o]), np.ones(n * m)]).astype(np.float32)
    who = np.concatenate([o, np.repeat(np.arange(n), m)])
    order = np.argsort(who, kind="stable")
    return code[order], x[order], np.concatenate([[0], np.cumsum(distinct + m)])


@dataclass
class Model:
    """bias (heads,), weight (features, heads), factor (features, heads * K)."""

    bias: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, code: np.ndarray, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores by the sum-of-squares identity, for every head at once."""
        h = len(self.bias)
        square = (self.factor**2).reshape(len(self.factor), h, -1).sum(2)
        start, size = offsets[:-1], np.diff(offsets)
        linear_and_sums = tk.row_sums(np.concatenate([self.weight, self.factor], 1), code, start, size, x)
        squares = tk.row_sums(square, code, start, size, x * x)
        sums = linear_and_sums[:, h:].reshape(len(size), h, -1)
        return self.bias + linear_and_sums[:, :h] + 0.5 * ((sums**2).sum(2) - squares)


def train(code: np.ndarray, x: np.ndarray, offsets: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.05, l2: float = 1e-4, seed: int = 5, balanced: tuple[int, ...] = ()) -> Model:
    """Full-batch Adam on the logistic loss; y is (rows, heads), NaN where a row has no label for a head."""
    n, h = y.shape
    known = ~np.isnan(y)
    y = np.where(known, y, 0)
    share = known / np.maximum(known.sum(0), 1)
    for k in balanced:  # both classes of the head weigh alike
        yes = known[:, k] & (y[:, k] == 1)
        if yes.any() and (known[:, k] & ~yes).any():
            share[:, k] *= np.where(yes, 0.5 / yes.sum(), 0.5 / (known[:, k] & ~yes).sum()) * known[:, k].sum()
    used, local = np.unique(code, return_inverse=True)
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros((len(used), h), np.float32), rng.normal(0, 0.02, (len(used), h * K)).astype(np.float32), np.zeros(h, np.float32)
    v[:, np.repeat(~known.any(0), K)] = 0
    row = np.repeat(np.arange(n), np.diff(offsets))
    by_code = np.argsort(local, kind="stable")
    code_start = np.searchsorted(local[by_code], np.arange(len(used)))
    code_size = np.diff(np.append(code_start, len(local)))
    xs, rows = x[by_code], row[by_code]
    params, m1, m2 = [b, w, v], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for t in range(1, epochs + 1):
        model = Model(b, w, v)
        g = (1 / (1 + np.exp(-np.clip(model.margins(local, x, offsets), -30, 30))) - y) * share
        g = g.astype(np.float32)
        s = tk.row_sums(v, local, offsets[:-1], np.diff(offsets), x)
        gs = np.concatenate([g, np.repeat(g, K, 1) * s], 1)
        lin = tk.row_sums(gs, rows, code_start, code_size, xs)
        sq = tk.row_sums(g, rows, code_start, code_size, xs * xs)
        grads = [g.sum(0), lin[:, :h] + l2 * w, lin[:, h:] - np.repeat(sq, K, 1) * v + l2 * v]
        for i, (p, gr) in enumerate(zip(params, grads, strict=True)):
            m1[i] = 0.9 * m1[i] + 0.1 * gr
            m2[i] = 0.99 * m2[i] + 0.01 * gr * gr
            p -= rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.99**t)) + 1e-8)
    weight, factor = np.zeros((N_WORDS + N_STATS, h), np.float32), np.zeros((N_WORDS + N_STATS, h * K), np.float32)
    weight[used], factor[used] = w, v
    return Model(b, weight, factor)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> Model:
    """Model from at most max_labelled labelled documents; labels holds doc_id and a 0/1 column per head."""
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), *HEADS).where("doc_id IS NOT NULL").where(" OR ".join(f"{c} IS NOT NULL" for c in HEADS))
        .groupBy("doc_id").agg(*(F.max(c).cast("double").alias(c) for c in HEADS))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most max_labelled small rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                code, x, off = features(part.column("text"), part.column("lang"))
                lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(a, kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([lists(code, pa.int32()), lists(x, pa.float32()), *(part.column(c) for c in HEADS)], names=["code", "x", *HEADS])

    one = texts(docs, F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id")
    got = one.mapInArrow(featurise, "code array<int>, x array<float>, " + ", ".join(f"{c} double" for c in HEADS)).toArrow()
    if not got.num_rows:
        empty = np.zeros((N_WORDS + N_STATS, len(HEADS) * K), np.float32)
        return Model(np.zeros(len(HEADS), np.float32), empty[:, : len(HEADS)], empty)
    code, x = (got.column(c).combine_chunks().flatten().to_numpy() for c in ("code", "x"))
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(got.column("code")).to_numpy())])
    y = np.stack([got.column(c).to_numpy() for c in HEADS], 1)
    return train(code.astype(np.int64), x, offsets, y, balanced=tuple(HEADS.index(c) for c in BALANCED))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality_score, keep, toxic_score and toxic (flags: score at least 0.5): one row per input row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: (N_WORDS + N_STATS) rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                p = 1 / (1 + np.exp(-np.clip(held.value.margins(*features(part.column("text"), part.column("lang"))), -30, 30).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for k in range(len(HEADS)) for x in (p[:, k], p[:, k] >= 0.5))], names=["doc_id", "quality_score", "keep", "toxic_score", "toxic"])

    return texts(docs, F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, quality_score double, keep boolean, toxic_score double, toxic boolean")
