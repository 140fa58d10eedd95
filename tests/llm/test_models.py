"""The trained models: identities, exact likelihoods and held-out accuracy."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from corpusloom.llm import hmm_lm, quality_fm
from corpusloom.llm.spark_util import table, texts


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    n, k = 50, quality_fm.K
    model = quality_fm.Model(np.array([0.3]), rng.normal(size=(n, 1)), rng.normal(size=(n, k)))
    code = np.concatenate([rng.permutation(n)[:7], rng.permutation(n)[:12]])
    x = rng.normal(size=19)
    got = model.margins(code, x, np.array([0, 7, 19, 19]))
    for r, (a, b) in enumerate([(0, 7), (7, 19), (19, 19)]):
        c, v = code[a:b], x[a:b]
        pairs = sum(model.factor[c[i]] @ model.factor[c[j]] * v[i] * v[j] for i, j in itertools.combinations(range(b - a), 2))
        assert got[r, 0] == pytest.approx(0.3 + model.weight[c, 0] @ v + pairs)


def test_classifier_on_held_out_labels(spark, sf_dir):
    """Trained on the labels of even documents, it tells those of the odd ones better than the larger class."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    scored = quality_fm.score(docs, quality_fm.fit(docs, labels.where("doc_id % 2 = 0")))
    got = scored.join(labels.where("doc_id % 2 = 1 AND quality IS NOT NULL"), "doc_id").collect()
    truth = np.array([r.quality for r in got])
    right = np.mean([r.keep == bool(r.quality) for r in got])
    assert right >= max(truth.mean(), 1 - truth.mean()) + 0.05
    assert scored.count() == docs.count()


def model(states, symbols, seed=1):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((symbols, states))
    return hmm_lm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def brute_likelihood(seq, m):
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        total += p
    return np.log(total)


def test_forward_is_exact():
    m = model(3, 5)
    seqs = [[0], [1, 2, 3], [4, 4, 0, 1, 2, 3], []]
    flat = np.array(sum(seqs, []), "<u2")
    got = hmm_lm.log_likelihood(flat, np.cumsum([0] + [len(s) for s in seqs]), m)
    assert got[:3] == pytest.approx([brute_likelihood(s, m) for s in seqs[:3]]) and got[3] == 0


def test_expected_counts_are_exact():
    m, seq = model(2, 3), [0, 2, 1, 1]
    z, moves, emissions, first = 0.0, np.zeros((2, 2)), np.zeros((3, 2)), np.zeros(2)
    for path in itertools.product(range(2), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        z += p
        first[path[0]] += p
        for t, s in enumerate(path):
            emissions[seq[t], s] += p
            if t:
                moves[path[t - 1], s] += p
    f, x, e, ll = hmm_lm.expected_counts(np.array(seq, "<u2"), np.array([0]), np.array([4]), np.array([True]), m)
    assert f == pytest.approx(first / z) and x == pytest.approx(moves / z) and e == pytest.approx(emissions / z) and ll == pytest.approx(np.log(z))


def test_stretches_change_nothing():
    """Expected counts of long documents in stretches are those of whole documents."""
    m = model(3, 7)
    rng = np.random.default_rng(5)
    sizes = [1, 700, 0, 8, 9, 64, 65, 300]
    offsets = np.cumsum([0, *sizes])
    symbols = rng.integers(0, 7, offsets[-1]).astype("<u2")

    def counted(limit, keep=0):
        start, size, begins = hmm_lm.stretches(offsets, limit, keep)
        before, behind, moves = hmm_lm.boundaries(symbols, start, size, begins, m)
        first, within, emissions, ll = hmm_lm.expected_counts(symbols, start, size, begins, m, before, behind)
        return first, within + moves * m.move, emissions, ll

    whole = counted(10_000)
    assert whole[1].sum() == pytest.approx(sum(max(0, n - 1) for n in sizes)) and whole[2].sum() == pytest.approx(sum(sizes))
    assert whole[3] == pytest.approx(hmm_lm.log_likelihood(symbols, offsets, m).sum())
    for limit, keep in ((1, 0), (8, 0), (64, 0), (64, 300), (9, 8)):
        for a, b in zip(counted(limit, keep), whole, strict=True):
            assert a == pytest.approx(b)


def test_training_raises_the_likelihood(spark, sf_dir):
    docs = texts(table(spark, sf_dir, "documents"))
    lex = hmm_lm.lexicon(hmm_lm.word_counts(docs), 300, 64)
    _, history = hmm_lm.baum_welch(hmm_lm.symbolise(docs, lex), lex.counts, 4, 4)
    assert all(b >= a for a, b in itertools.pairwise(history)) and history[-1] > history[0]


def test_counts_cover_the_corpus(spark, make_docs):
    docs = texts(make_docs([(1, "The cat, the CAT"), (2, "a dog!"), (3, None), (1, "The cat, the CAT")]))
    counts = hmm_lm.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == {"the": 4, "cat": 4, "a": 1, "dog": 1}
    lex = hmm_lm.lexicon(counts, 2, 4)
    assert lex.counts.sum() == 10 and lex.counts[2:].sum() == 2
    assert sorted(lex.of(hmm_lm.word_hashes(pa.array(["cat", "the"])))) == [0, 1]
    assert sorted(r.n for r in hmm_lm.rare_counts(counts, lex).collect()) == [1, 1]


def test_scores_against_brute_force(make_docs):
    """The score of every document is its symbols' likelihood by all paths, times each rare word's share of its bucket in the corpus."""
    rows = [(1, "one two three"), (2, "four one five five"), (None, "Two! six"), (3, ""), (4, None), (2, "four one five five"), (5, "seven one seven"), (6, "- ...")]
    docs = texts(make_docs(rows))
    counts = hmm_lm.word_counts(docs)
    lex = hmm_lm.lexicon(counts, 2, 3)
    m = model(2, 5)
    got = hmm_lm.score_sequences(hmm_lm.stage(hmm_lm.symbolise(docs, lex)), hmm_lm.rare_counts(counts, lex), m, lex).collect()
    n = {r.word: r.n for r in counts.collect()}
    symbol = {w: int(lex.of(hmm_lm.word_hashes(pa.array([w])))[0]) for w in n}
    words = [[w for w in (x.strip("-.!").lower() for x in (t or "").split()) if w] for _, t in rows]
    share = lambda w: n[w] / sum(n[v] for v in n if symbol[v] == symbol[w])
    want = [(d, len(w), (brute_likelihood([symbol[x] for x in w], m) if w else 0) + sum(np.log(share(x)) for x in w)) for (d, _), w in zip(rows, words, strict=True)]
    key = lambda r: (r[0] or 0, r[1], r[2])
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.log_likelihood) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b)
    assert all((r.perplexity is None) == (r.n_tokens == 0) for r in got)


def test_toxicity_on_held_out_labels(spark, sf_dir):
    """Trained on the labels of even documents, the toxic head flags toxic ones among the odd with few errors (README: about a third of them), and the quality head still holds."""
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "labels")
    got = quality_fm.score(docs, quality_fm.fit(docs, labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality", "toxic_score", quality_fm.F.col("toxic_score") >= 0.5, labels.toxic).toPandas()
    got.columns = ["keep", "quality", "score", "flag", "toxic"]
    known = got[got.toxic.notna()]
    flag, toxic = known.flag.to_numpy(bool), known.toxic.to_numpy() == 1
    known = got[got.quality.notna()]
    assert (known.keep.to_numpy(bool) == (known.quality == 1).to_numpy()).mean() >= 0.95
    assert toxic.sum() > 20 and flag[toxic].mean() >= 0.3 and toxic[flag].mean() >= 0.8


def test_heads_are_masked_where_unlabelled():
    """A head learns from its own labels as if rows without one weren't there; a head without labels scores 0.5."""
    code, x, off = np.arange(8) % 4, np.ones(8), np.arange(9)
    nan = np.nan
    m = quality_fm.train(code, x, off, np.array([[1, nan], [0, nan], [1, nan], [nan, nan]] * 2))
    p = 1 / (1 + np.exp(-m.margins(code, x, off)))
    assert (p[:, 1] == 0.5).all() and p[0, 0] > 0.8 and p[1, 0] < 0.2
