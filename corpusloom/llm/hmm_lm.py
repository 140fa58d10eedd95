"""Hidden Markov language model: Baum-Welch over the whole corpus, exact likelihood of each document.

Words (folded tokens) are counted over all documents. The ``vocabulary`` most frequent are symbols of
their own; the others fall into ``buckets`` hashed symbols, and within a bucket a word has its share of
the bucket's tokens in the corpus. So the latent states emit a table of fixed size, and the counts of
all words, a table that grows with the corpus, tell the words of a bucket apart: at scoring every
portion of documents asks for the counts of the words it holds (once for each), in a join.

Each iteration maps the forward-backward recursion over whole documents, every partition emitting its
expected counts, which Spark sums; the driver only normalises tables of fixed size. So that the steps
of a document of over LONG tokens can be taken side by side, it is handled in stretches of STRETCH tokens: products
of the transitions along each give the exact forward vector at its start and backward vector at its
end, and the transitions between stretches are counted as all others. Scoring runs the scaled forward
recursion over whole documents; the log-likelihood is exact up to rounding.

Defined results. A null text or one without words has zero tokens, log-likelihood 0 and a null
perplexity. One row per input row: repeated rows repeat (and count in training as often as they
stand), a null doc_id is carried through, an empty table gives an empty result. Ties in frequency go
to the word that sorts first. Columns other than doc_id and text are not read.
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
from .spark_util import cut, release, stage, texts

STATES, VOCABULARY, BUCKETS, ITERATIONS = 8, 4096, 1024, 4
LONG, STRETCH = 4096, 512
#: Tokens handled at once by a Python worker in training.
CHUNK = 400_000


@dataclass
class Lexicon:
    """Sorted hashes of the frequent words with their symbols, the number of buckets, and the tokens of each symbol."""

    hashes: np.ndarray
    symbols: np.ndarray
    buckets: int
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes) + self.buckets

    def of(self, h: np.ndarray) -> np.ndarray:
        """Symbols of words given by their hashes."""
        bucket = len(self.hashes) + (h % tk.U64(self.buckets)).astype(np.int64)
        if not len(self.hashes):
            return bucket
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.symbols[at], bucket)

    def log_size(self) -> np.ndarray:
        """log of the tokens of each bucket, 0 for words that are symbols of their own."""
        return np.concatenate([np.zeros(len(self.hashes)), np.log(np.maximum(self.counts[len(self.hashes) :], 1))])


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # (symbols, states), columns sum to 1


def folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, words) of folded tokens; tokens of punctuation alone are left out."""
    tok = tk.tokenise(text)
    enc = tk.fold(tok.words).dictionary_encode()
    words = enc.dictionary
    codes = enc.indices.to_numpy(zero_copy_only=False)[tok.codes] if len(tok.codes) else np.zeros(0, np.int64)
    keep = ~pc.equal(words, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[tok.offsets], words


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                codes, _, words = folded(part.column("text"))
                n = np.bincount(codes, minlength=len(words))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), pa.array(n[some])], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_hashes(words: pa.Array) -> np.ndarray:
    return tk.hash_strings(words, 13)


def lexicon(counts: DataFrame, vocabulary: int, buckets: int) -> Lexicon:
    """From word_counts()."""
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()  # at most ``vocabulary`` rows
    h = word_hashes(tk.as_string(top.column("word")))
    order = np.argsort(h)
    lex = Lexicon(h[order], order, buckets, np.zeros(0))
    held = counts.sparkSession.sparkContext.broadcast(lex)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.zeros(held.value.size, np.int64)
        for batch in batches:
            np.add.at(tokens, held.value.of(word_hashes(batch.column("word"))), batch.column("n").to_numpy())
        some = np.flatnonzero(tokens)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(tokens[some])], names=["symbol", "tokens"])

    got = counts.mapInArrow(tally, "symbol long, tokens long").groupBy("symbol").agg(F.sum("tokens").alias("tokens")).toArrow()
    tokens = np.zeros(lex.size)
    tokens[got.column("symbol").to_numpy()] = got.column("tokens").to_numpy()
    return Lexicon(lex.hashes, lex.symbols, buckets, tokens)


def rare_counts(counts: DataFrame, lex: Lexicon) -> DataFrame:
    """h, n of the words that aren't symbols of their own."""
    held = counts.sparkSession.sparkContext.broadcast(lex)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = word_hashes(batch.column("word"))
            rare = held.value.of(h) >= len(held.value.hashes)
            yield pa.RecordBatch.from_arrays([pa.array(h[rare].view(np.int64)), batch.column("n").filter(pa.array(rare))], names=["h", "n"])

    return counts.mapInArrow(run, "h long, n long")


def binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """flat[offsets[i]:offsets[i+1]] as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


SEQUENCES = "portion long, doc_id long, symbols binary, rare binary, asked binary"


def symbolise(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """portion, doc_id, symbols (16-bit integers) and rare (32-bit integers) of each row; and for each
    portion of rows a further row, of null symbols, with the hashes of the rare words asked for, which the
    rows' rare tokens point to."""
    held = docs.sparkSession.sparkContext.broadcast(lex)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                codes, off, words = folded(part.column("text"))
                h = word_hashes(words)
                symbol = held.value.of(h)
                s = symbol[codes].astype("<u2") if len(codes) else np.zeros(0, "<u2")
                is_rare = (symbol >= len(held.value.hashes))[codes] if len(codes) else np.zeros(0, bool)
                asked, rare = np.unique(codes[is_rare], return_inverse=True)
                rare_off = np.concatenate([[0], np.cumsum(is_rare)])[off]
                n = part.num_rows
                portion = pa.array(np.full(n, part.column("row")[0].as_py() if n else 0, np.int64))
                nothing = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([portion, part.column("doc_id"), binaries(s, off), binaries(rare.astype("<u4"), rare_off), nothing], names=["portion", "doc_id", "symbols", "rare", "asked"])
                if len(asked):
                    one = [portion[:1], pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([h[asked].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(one, names=["portion", "doc_id", "symbols", "rare", "asked"])

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, SEQUENCES)


def answers(sequences: DataFrame, rare: DataFrame) -> DataFrame:
    """portion, place, n: the corpus count of each rare word that a portion asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion, asked in zip(batch.column("portion").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                h = np.frombuffer(asked, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), portion)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], names=["portion", "place", "h"])

    asked = sequences.where("asked IS NOT NULL").select("portion", "asked").mapInArrow(run, "portion long, place int, h long")
    return asked.join(rare, "h").select("portion", "place", "n")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values, offsets) of binaries()."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, offsets = tk.string_bytes(column)
    return raw.view(kind), offsets // np.dtype(kind).itemsize


def _active(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of falling size, and how many are longer than t for t = 0, 1, …"""
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")


def log_likelihood(symbols: np.ndarray, offsets: np.ndarray, model: Hmm) -> np.ndarray:
    """Exact log-likelihoods of whole symbol sequences by the scaled forward recursion."""
    size = np.diff(offsets)
    order, active = _active(size)
    start = offsets[:-1][order]
    ll = np.zeros(len(size))
    alpha = np.repeat(model.start[None], len(size), 0)
    for t, m in enumerate(active):
        alpha = alpha[:m] @ model.move if t else alpha[:m]
        alpha *= np.take(model.emit, symbols[start[:m] + t], axis=0)
        c = alpha.sum(1)
        alpha /= c[:, None]
        ll[:m] += np.log(c)
    out = np.zeros(len(size))
    out[order] = ll
    return out


def boundaries(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, begins: np.ndarray, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state's distribution before each stretch, given all before it; the backward vector at each
    stretch's end, up to a factor; and the expected moves between stretches, short of the transitions."""
    n, s = len(start), len(model.start)
    before, behind, moves = np.repeat(model.start[None], n, 0), np.ones((n, s)), np.zeros((s, s))
    goes_on = np.append(~begins[1:], False) if n else np.zeros(0, bool)  # the next stretch is of the same document
    several = np.flatnonzero(goes_on | ~begins)
    if not len(several):
        return before, behind, moves
    # products of emissions and transitions along each stretch, all stretches a step at a time
    order, active = _active(size[several])
    first = start[several][order]
    m = np.zeros((len(several), s, s))
    for t, k in enumerate(active):
        emit = np.take(model.emit, symbols[first[:k] + t], axis=0)
        m[:k] = (m[:k] @ model.move if t else np.eye(s)[None]) * emit[:, None, :]
        m[:k] /= m[:k].sum((1, 2), keepdims=True)
    along = np.empty_like(m)
    along[order] = m
    place = np.full(n, -1)
    place[several] = np.arange(len(several))
    # stretch by stretch, all documents at a time
    head = np.flatnonzero(begins & goes_on)
    nth = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    at, levels = head, []
    while len(at):
        levels.append(at)
        at = at[goes_on[at]] + 1
    for at in levels:
        at = at[goes_on[at]]
        p = np.einsum("ni,nij->nj", before[at], along[place[at]]) @ model.move
        before[at + 1] = p / p.sum(1, keepdims=True)
    for at in reversed(levels[1:]):
        ahead = np.einsum("nij,nj->ni", along[place[at]], behind[at])  # emission and backward vector at the first token
        end = np.einsum("ni,nij->nj", before[at - 1], along[place[at - 1]])
        b = ahead @ model.move.T
        moves += (end / (end * b).sum(1, keepdims=True)).T @ ahead
        behind[at - 1] = b / b.sum(1, keepdims=True)
    assert nth.max() + 1 == len(levels)
    return before, behind, moves


def expected_counts(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, begins: np.ndarray, model: Hmm, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward over stretches: expected (starts, moves within them, emissions by symbol), log-likelihood."""
    s = len(model.start)
    order, active = _active(size)
    start, begins = start[order], begins[order]
    alpha = np.repeat(model.start[None], len(size), 0) if before is None else before[order]
    behind = np.ones((len(size), s)) if behind is None else behind[order]
    alphas, scales, ll = [], [], 0.0
    for t, m in enumerate(active):
        alpha = alpha[:m] @ model.move if t else alpha[:m]
        alpha = alpha * np.take(model.emit, symbols[start[:m] + t], axis=0)
        c = alpha.sum(1)
        alpha /= c[:, None]
        ll += np.log(c).sum()
        alphas.append(alpha)
        scales.append(c)
    moves = np.zeros((s, s))
    weights = np.zeros((len(symbols), s))
    beta = np.zeros((0, s))
    for t in range(len(active) - 1, -1, -1):
        m, k = active[t], active[t + 1] if t + 1 < len(active) else 0
        new = behind[:m] / (alphas[t] * behind[:m]).sum(1, keepdims=True)  # for those that end here
        if k:
            ahead = np.take(model.emit, symbols[start[:k] + t + 1], axis=0) * beta / scales[t + 1][:, None]
            moves += alphas[t][:k].T @ ahead
            new[:k] = ahead @ model.move.T
        beta = new
        weights[start[:m] + t] = alphas[t] * beta
    first = weights[start[: len(size)][begins & (size[order] > 0)]].sum(0)
    emissions = np.stack([np.bincount(symbols, weights=weights[:, j], minlength=len(model.emit)) for j in range(s)], 1)
    return first, moves * model.move, emissions, ll


def stretches(offsets: np.ndarray, limit: int, whole: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, begins a document) of the stretches: documents of up to ``whole`` tokens, and at most ``limit`` tokens of others."""
    size = np.diff(offsets)
    limit = np.where(size <= whole, np.maximum(size, 1), limit)
    parts = -(-size // limit)
    limit = np.repeat(limit, parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(offsets[:-1], parts) + nth * limit
    return start, np.minimum(limit, np.repeat(offsets[1:], parts) - start), nth == 0


def initial(counts: np.ndarray, states: int, seed: int = 3) -> Hmm:
    rng = np.random.default_rng(seed)
    base = (counts + 0.5) / (counts + 0.5).sum()
    emit = base[:, None] * rng.uniform(0.5, 1.5, (len(base), states))
    move = rng.uniform(0.5, 1.5, (states, states)) + np.eye(states)
    return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def baum_welch(sequences: DataFrame, counts: np.ndarray, states: int, iterations: int) -> tuple[Hmm, list[float]]:
    """Model and the training log-likelihood before each iteration."""
    model, history = initial(counts, states), []
    prior = (counts + 0.5) / (counts + 0.5).sum()
    v = len(counts)
    for _ in range(iterations):
        held = sequences.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            m = held.value
            total = np.zeros(states + states * states + v * states + 1)
            for batch in batches:
                symbols, offsets = _flat(batch.column("symbols"), "<u2")
                start, size, begins = stretches(offsets, STRETCH, LONG)
                before, behind, moves = boundaries(symbols, start, size, begins, m)
                total[states : states + states**2] += moves.ravel()
                # stretches of like size together, as a portion takes as many steps as its longest
                order = np.argsort(size, kind="stable")
                size, begins, before, behind = size[order], begins[order], before[order], behind[order]
                first = np.cumsum(size) - size
                symbols = symbols[np.repeat(start[order] - first, size) + np.arange(size.sum())]
                start, a = first, 0
                while a < len(start):
                    b = max(a + 1, int(np.searchsorted(start, start[a] + CHUNK)))
                    lo, hi = start[a], start[b - 1] + size[b - 1]
                    f, x, e, ll = expected_counts(symbols[lo:hi], start[a:b] - lo, size[a:b], begins[a:b], m, before[a:b], behind[a:b])
                    x /= m.move  # the factor is put in once, below
                    total += np.concatenate([f, x.ravel(), e.ravel(), [ll]])
                    a = b
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "amount"])

        got = sequences.where("symbols IS NOT NULL").select("symbols").mapInArrow(run, "slot long, amount double").groupBy("slot").agg(F.sum("amount").alias("amount")).toArrow()
        total = np.zeros(states + states * states + v * states + 1)
        total[got.column("slot").to_numpy()] = got.column("amount").to_numpy()
        history.append(float(total[-1]))
        first, moves, emissions = total[:states], total[states : states + states**2].reshape(states, states), total[states + states**2 : -1].reshape(v, states)
        moves = moves * model.move
        first, moves, emissions = first + 1, moves + 1, emissions + states * prior[:, None]
        model = Hmm(first / first.sum(), moves / moves.sum(1, keepdims=True), emissions / emissions.sum(0))
        held.unpersist()
    return model, history


def score_sequences(sequences: DataFrame, rare: DataFrame, model: Hmm, lex: Lexicon) -> DataFrame:
    held = sequences.sparkSession.sparkContext.broadcast((model, lex.log_size()))  # of fixed size

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        model, log_size = held.value
        symbols, offsets = _flat(rows.column("symbols"), "<u2")
        places, rare_offsets = _flat(rows.column("rare"), "<u4")
        log_n = np.zeros(int(places.max()) + 1 if len(places) else 0)
        log_n[told.column("place").to_numpy()] = np.log(told.column("n").to_numpy())
        n = np.diff(offsets)
        ll = log_likelihood(symbols, offsets, model) - tk.segment_sum(log_size[symbols], offsets) + tk.segment_sum(log_n[places], rare_offsets, np.float64)
        ppl = np.exp(np.minimum(-ll / np.maximum(n, 1), 700))
        return pa.table([rows.column("doc_id"), pa.array(n), pa.array(ll), pa.array(ppl, mask=n == 0)], names=["doc_id", "n_tokens", "log_likelihood", "perplexity"])

    rows = sequences.where("symbols IS NOT NULL").select("portion", "doc_id", "symbols", "rare")
    both = rows.groupBy("portion").cogroup(answers(sequences, rare).groupBy("portion"))
    return both.applyInArrow(run, "doc_id long, n_tokens long, log_likelihood double, perplexity double")


def score(docs: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY, buckets: int = BUCKETS, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (natural), perplexity (per token), by a model of these documents."""
    if vocabulary + buckets > 1 << 16:
        raise ValueError("vocabulary and buckets together must fit 16 bits")
    one = texts(docs)
    counts = cut(word_counts(one))
    lex = lexicon(counts, vocabulary, buckets)
    sequences = stage(symbolise(one, lex))
    model, _ = baum_welch(sequences, lex.counts, states, iterations)
    release(docs.sparkSession)
    return score_sequences(sequences, rare_counts(counts, lex), model, lex)
