"""Duplicate searches against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import corpus_pipeline
import pytest
from corpusloom.llm import edit_distance, line_dedup, simhash_dedup, substring_dedup
from corpusloom.llm import textkit as tk
from corpusloom.llm.edit_distance import within
from corpusloom.llm.spark_util import components

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "sto", "vi", "den") for c in ("", "n", "ter", "lig")]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounded_distance():
    rng = random.Random(1)
    left, right = [], []
    for _ in range(200):
        a = "".join(rng.choice("abcé日") for _ in range(rng.randrange(25)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        left.append(a)
        right.append("".join(b))
    limits = np.array([rng.randrange(6) for _ in left])
    want = [levenshtein(a, b) <= m for a, b, m in zip(left, right, limits, strict=True)]
    assert within(left, right, limits).tolist() == want


def test_bit_vectors_equal_points():
    """Both ways of the bounded distance, on texts of one to six words of 64 characters, equal a plain table."""
    rng = random.Random(2)
    for size in (5, 64, 65, 130, 200, 380):
        left, right = [], []
        for _ in range(40):
            a = "".join(rng.choice("abcé日") for _ in range(size))
            b = list(a)
            for _ in range(rng.randrange(1 + size // 6)):
                k = rng.randrange(len(b) + 1)
                b[k : k + rng.randrange(2)] = rng.choice(["", "x", "ab"])
            left.append(a)
            right.append("".join(b) or "x")
        limits = np.array([rng.randrange(1 + size // 5) for _ in left])
        want = [levenshtein(a, b) <= m for a, b, m in zip(left, right, limits, strict=True)]
        assert edit_distance._by_points(left, right, limits).tolist() == want
        assert edit_distance._by_bits(left, right, limits, -(-size // 64)).tolist() == want
        assert within(left * 30, right * 30, np.tile(limits, 30)).tolist() == want * 30


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 3), (20, 21), (5, 5), (None, 4), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect() if r.node != r.root}
    want = {2: 1, 3: 1, 10: 1, 11: 1, 21: 20} | {101 + i: 100 for i in range(40)}
    assert got == want


def make_lines(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 14))) for _ in range(150)]
    for base in lines[:50]:
        w = base.split()
        w[rng.randrange(len(w))] += rng.choice(["s", "x", "q"])
        lines.append(" ".join(w))
        if rng.random() < 0.3:
            lines.append(base.title() + "!")
    rng.shuffle(lines)
    return lines


def normal(line):
    return " ".join(w for w in (t.lower().strip(tk.PUNCTUATION) for t in line.split()) if w)


def groups(n, pairs):
    root = list(range(n))
    for a, b in sorted(pairs):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_line_dedup_against_brute_force(make_docs):
    found = want_found = 0
    for seed in range(3):
        lines = make_lines(seed)
        places = [(d, k) for d in range(0, len(lines), 5) for k in range(min(5, len(lines) - d))]
        docs = make_docs([(d, "\n".join(lines[d : d + 5])) for d in range(0, len(lines), 5)])
        n = [normal(x) for x in lines]
        near = {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if levenshtein(n[i], n[j]) <= (1 - line_dedup.SIMILARITY) * max(len(n[i]), len(n[j])) + 1e-9}
        root = groups(len(n), near)
        want = {places[i] + places[r] for i, r in enumerate(root) if i != r}
        got = {tuple(r) for r in line_dedup.removals(docs).collect()}
        assert {g[:2] for g in got} <= {w[:2] for w in want}  # never more than brute force removes
        found += len({g[:2] for g in got})
        want_found += len(want)
    assert found >= 0.9 * want_found > 90


def at_the_bound(rng, line, kind):
    """The line with every edit that the bound allows: a random character put in, replaced or taken out at random places."""
    chars, k = list(line), int(0.1 * len(line))
    if kind == "insert":
        k = int(0.1 * (len(line) + k))
    for _ in range(k):
        if kind == "insert":
            chars.insert(rng.randrange(len(chars) + 1), rng.choice("xyzq"))
        elif kind == "end":
            ends = [i for i, c in enumerate(chars) if c == " "] + [len(chars)]
            chars.insert(rng.choice(ends), rng.choice("xyzq"))
        else:
            i = rng.choice([i for i, c in enumerate(chars) if c != " "])
            chars[i : i + 1] = rng.choice("xyzq") if kind == "replace" else ""
    return "".join(chars)


@pytest.mark.parametrize("kind", ["insert", "end", "replace", "delete"])
@pytest.mark.parametrize("n_words", [2, 3, 4, 6, 8, 12, 16, 24, 40, 80, 160])
def test_line_dedup_recall_at_the_bound(n_words, kind):
    """Pairs as far apart as copies may be meet in a block and are near by SimHash, at every length."""
    rng = random.Random(4)
    n = 300
    a = [" ".join(rng.choice(WORDS) for _ in range(n_words)) for _ in range(n)]
    b = [at_the_bound(rng, x, kind) for x in a]
    _, _, tok, length = line_dedup.normal_lines(pa.array(a + b))
    words = line_dedup.word_units(tok)
    blocks = line_dedup.blocks_of(tok, words, length, line_dedup.line_hashes(words), None)
    of = [set() for _ in range(2 * n)]
    for key, line in zip(blocks.key.tolist(), blocks.line.tolist(), strict=True):
        of[line].add(key)
    met = np.array([bool(of[i] & of[n + i]) for i in range(n)])
    fp = line_dedup.fingerprints(line_dedup.joined(tok))
    longer = np.maximum(length[:n], length[n:])
    near = tk.hamming(fp[:n], fp[n:]) <= line_dedup.NEAR + line_dedup.NEAR_ROOT / np.sqrt(longer)
    assert (met & near).mean() >= 0.9


def met_pairs(rows, similarity=0.9):
    key, short, before, n = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.uint64, np.int64, np.int64), strict=True))
    return {tuple(p) for part in line_dedup.pairs_in(key, short, before, n, similarity) for p in part.tolist()}


def test_lines_meet_where_the_rest_may_align():
    rows = [(1, 10, 0, 100), (1, 11, 4, 108), (1, 12, 40, 100), (2, 10, 7, 100), (2, 10, 7, 100), (3, 12, 0, 100)]
    assert met_pairs(rows) == {(10, 11)}
    several = [(5, 100 + i, 3, 40) for i in range(line_dedup.WINDOW + 1)]
    assert len(met_pairs(several)) == len(several) * (len(several) - 1) // 2  # all pairs of a block that isn't large


def test_large_blocks_hold_together():
    rows = [(key, 1000 + i, 3, 40) for key in range(4) for i in range(5000)]
    pairs = met_pairs(rows)
    assert len(pairs) <= 4 * line_dedup.WINDOW * 5000
    assert len(set(groups_fast(pairs))) == 1


def brute_meetings(key, short, before, n, lanes, group):
    """Pairs of lines of different groups that share a block, may align there and are near by SimHash."""
    out = set()
    for i in range(len(key)):
        j = np.flatnonzero((key == key[i]) & (group != group[i]))
        longer = np.maximum(n[j], n[i])
        j = j[(np.abs(before[j] - before[i]) + np.abs(n[j] - before[j] - n[i] + before[i]) <= line_dedup.shifts(longer, 0.9)) & (tk.hamming(lanes[j], np.repeat(lanes[i : i + 1], len(j), 0)) <= line_dedup.bits_apart(longer))]
        out |= {(min(short[i], short[k]), max(short[i], short[k])) for k in j}
    return out


@pytest.mark.parametrize("tile", [50, 4096])
def test_large_blocks_are_compared_whole(monkeypatch, tile):
    """Blocks far beyond the window lose no pair, in one tile or in many."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    monkeypatch.setattr(line_dedup, "AT_ONCE", 3000)
    rng = np.random.default_rng(8)
    m = 1400
    short = np.arange(m).astype(np.uint64)
    key = np.repeat(np.arange(4), [700, 400, 290, 10]).astype(np.uint64)
    before, n = rng.integers(0, 60, m), rng.integers(60, 160, m)
    lanes = np.repeat(rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64), m, 0)
    for _ in range(6):  # bits that differ: about 27 of 256 set
        lanes ^= np.uint64(1) << rng.integers(0, 64, (m, 4)).astype(np.uint64)
    group = rng.integers(0, 300, m)
    large = []
    list(line_dedup.pairs_in(key, short, before, n, 0.9, large))
    assert len(large[0][0]) == 1390  # the block of 10 isn't large
    got, tiles = set(), 0
    for ids, s, b, size, second in line_dedup.tiles(*large[0], 0.9):
        i = s.astype(np.int64)
        tiles += len(np.unique(ids))
        for x, y in line_dedup.near_in(ids, b, size, second, group[i], lanes[i], n[i], 0.9):
            got |= {(min(s[p], s[q]), max(s[p], s[q])) for p, q in zip(x, y, strict=True)}
    want = brute_meetings(*(v[key < 3] for v in (key, short, before, n, lanes, group)))
    assert got == want and len(want) > 1000
    assert (tiles > 28) if tile == 50 else (tiles == 3)


def common_stretch(make_docs):
    """Pairs of copies with an edit in every other stretch, which meet only on one that hundreds of lines share: lines, their order, documents of three."""
    rng = random.Random(12)
    stem, lines = "in the course of the year", []
    for _ in range(150):
        tail = "".join(rng.choice("abcdefghijklmnopr") for _ in range(80))
        far = list(tail)
        for i in range(3, 80, 8):  # ten edits of 106 characters, no eight between them
            far[i] = "z"
        lines += [f"{stem} {tail}", f"{stem} {''.join(far)}"]
    assert all(levenshtein(a, b) <= 10 for a, b in zip(lines[::2], lines[1::2], strict=True))
    order = list(range(len(lines)))
    rng.shuffle(order)
    return lines, order, make_docs([(d, "\n".join(lines[i] for i in order[d : d + 3])) for d in range(0, len(order), 3)])


def test_lines_that_share_a_common_stretch_alone(make_docs):
    """A stretch that hundreds of lines share hides no pair."""
    lines, order, docs = common_stretch(make_docs)
    gone = line_dedup.removals(docs).collect()
    assert len(gone) >= 0.9 * len(lines) / 2
    place = {(d, k): order[d + k] for d in range(0, len(order), 3) for k in range(3)}
    assert all(place[r.doc_id, r.line_no] // 2 == place[r.kept_doc_id, r.kept_line_no] // 2 for r in gone)
    assert len({(r.doc_id, r.line_no) for r in gone}) == len(gone)


def test_pipeline_stage_on_a_common_stretch(spark, make_docs):
    """The pipeline's stage leaves one line of nearly every pair, and both of none that differ more."""
    lines, _, docs = common_stretch(make_docs)
    left = [x for r in corpus_pipeline.lines(spark, docs, "").collect() for x in r.text.split("\n")]
    assert len(set(left)) == len(left) <= 0.55 * len(lines)
    assert {lines.index(x) // 2 for x in left} == set(range(len(lines) // 2))


@pytest.mark.parametrize("kind", ["insert", "end", "replace", "delete"])
def test_profiles_lose_no_similar_pair(kind):
    """Whatever lies within the bound is left to the edit distance, and few of the others are."""
    rng = random.Random(6)
    a = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    lines = pa.array([*a, *(at_the_bound(rng, x, kind) for x in a), "x", "", "é" * 40000])
    x, y = np.arange(200), np.arange(200, 400)
    most = np.array([levenshtein(lines[i].as_py(), lines[j].as_py()) for i, j in zip(x, y, strict=True)])
    profile = line_dedup.profiles(lines)
    assert line_dedup.may_match(profile, x, y, most).all()
    assert line_dedup.may_match(profile, x, np.roll(y, 1), most).mean() < 0.1
    assert profile.shape == (403, 320) and not profile[401].any() and profile[402].max() == 32767


@pytest.mark.parametrize("kind", ["insert", "end", "replace", "delete"])
def test_tallies_and_triples_lose_no_similar_pair(kind):
    """Counts of characters and of stretches of three leave whatever lies within the bound, up to their greatest number too."""
    rng = random.Random(8)
    a = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    lines = pa.array([*a, *(at_the_bound(rng, x, kind) for x in a), "x", "", "é" * 40000])
    length = np.array([len(x) for x in lines.to_pylist()])
    x, y = np.arange(200), np.arange(200, 400)
    most = np.array([levenshtein(lines[i].as_py(), lines[j].as_py()) for i, j in zip(x, y, strict=True)])
    for counts, by in ((line_dedup.tally(lines, length), 1), (line_dedup.triples(lines, length), 3)):
        assert line_dedup.within_counts(counts, x, y, by * most).all()
        assert line_dedup.within_counts(counts, x, np.roll(y, 1), by * most).mean() < 0.2
        assert len(counts) == 403 and not counts[401].any() and counts[402].max() == np.iinfo(counts.dtype).max


def test_large_blocks_send_on_what_may_be_similar_alone(spark):
    """Of the lines of a tile that are near by SimHash those whose tallies differ too much aren't moved further, and no others are left out."""
    lines = pa.array(["abcdefghij" * 10, "abcdefghij" * 9 + "zzzzzzzzzz", "abcdefghij" * 8 + "z" * 20, "klmnopqrst" * 10])
    h, n = [(i + 1) << 16 for i in range(4)], np.full(4, 100)
    counts = line_dedup.tally(lines, n).view(np.int64)
    rows = [(h[i], 100, x, *[0] * len(line_dedup.LANES), *counts[i].tolist()) for i, x in enumerate(lines.to_pylist())]
    text = spark.createDataFrame(rows, f"h long, n long, norm string, {', '.join(f'{c} long' for c in (*line_dedup.LANES, *line_dedup.TALLIES))}")
    members = spark.createDataFrame([(x >> 16, 7, 10, 100, False) for x in h], "a long, b long, before int, n int, second boolean")
    roots = spark.createDataFrame([], "node long, root long")
    got = {tuple(r) for r in line_dedup.rest_of_large(members, text, roots, 0.9).collect()}
    assert got == {(h[0], h[1]), (h[1], h[2])}


@pytest.mark.parametrize("most", [1, 8, 1 << 23])
def test_filter_holds_every_wanted_line(spark, most):
    spots = [(d * (-1) ** d * 3**30, n) for d in range(40) for n in range(0, 30, 7)]
    words = line_dedup.filter_of(spark.createDataFrame(spots, "doc_id long, line_no int"), most)
    place, bits = line_dedup.filter_place(*np.array(spots).T, len(words))
    assert len(words) <= most and (words[place] & bits == bits).all()
    if most > 8:
        place, bits = line_dedup.filter_place(np.arange(20_000) + 5, np.arange(20_000), len(words))
        assert (words[place] & bits == bits).mean() < 0.05


def test_texts_of_lines_are_read_in_place(make_docs, spark):
    rows = [(-7, "one line of text here\n\nand another, longer line of text"), (8, "nothing wanted at all"), (9, "a third line, which is wanted"), (10, None)]
    wanted = spark.createDataFrame([(-7, 2), (9, 0), (9, 5), (11, 0)], "doc_id long, line_no int")
    found = line_dedup.line_texts(make_docs([*rows, rows[0]]), wanted)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [r.norm for r in found.collect()]
    assert got.count("and another longer line of text") == 2 and got.count("a third line which is wanted") == 1


def test_merged_groups(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (11, 10), (12, 10), (21, 20)], "node long, root long")
    links = spark.createDataFrame([(3, 12), (30, 31), (31, 21), (5, 40)], "a long, b long")
    got = {r.node: r.root for r in line_dedup.merged(roots, links).collect()}
    assert got == {2: 1, 3: 1, 10: 1, 11: 1, 12: 1, 21: 20, 30: 20, 31: 20, 40: 5}
    none = spark.createDataFrame([], "a long, b long")
    assert {r.node: r.root for r in line_dedup.merged(roots, none).collect()} == {2: 1, 3: 1, 11: 10, 12: 10, 21: 20}


def groups_fast(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    return [top(x) for x in list(root)]


def test_linked_pairs_hold_their_groups_together():
    """Some pairs are left out, but the groups are those of all similar pairs; repeated lines and pairs change nothing."""
    rng = random.Random(9)
    lines = []
    for _ in range(4):
        base = [rng.choice(WORDS) for _ in range(20)]
        lines.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(20)] = rng.choice(WORDS)
            lines.append(" ".join(w))
    lines = sorted(set(lines))
    h = [rng.randrange(-(2**63), 2**63) for _ in lines]
    pairs = [(h[i], h[j]) for i in range(len(h)) for j in range(len(h)) if h[i] < h[j] and rng.random() < 0.8]
    pairs += pairs[:50]
    at = {x: i for i, x in enumerate(h)}
    similar = {(at[a], at[b]) for a, b in pairs if levenshtein(lines[at[a]], lines[at[b]]) <= 0.1 * max(len(lines[at[a]]), len(lines[at[b]]))}
    got = line_dedup.linked(pa.table({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}), pa.table({"h": [*h, h[0]], "norm": [*lines, lines[0]]}), 0.9)
    got = {(at[a], at[b]) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)}
    assert got < similar
    assert groups(len(h), got) == groups(len(h), similar)


def test_linked_pairs_close_no_ring():
    """Of copies that all pair with the same two no more pairs come than hold them together."""
    lines = [f"a line of many words that all of the copies share but for its end {c}" for c in "abcdefghijklmnop"]
    h = [(7 * i % 16) << 20 for i in range(16)]
    pairs = [(a, b) for a in sorted(h)[:2] for b in sorted(h)[2:]]
    got = line_dedup.linked(pa.table({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}), pa.table({"h": h, "norm": lines}), 0.9)
    at = {x: i for i, x in enumerate(h)}
    assert got.num_rows == 15 and set(groups(16, {(at[a], at[b]) for a, b in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)})) == {0}


def test_bit_vectors_give_up_no_similar_pair():
    """Pairs given up on the way are beyond the limit, and pairs of unlike lengths may share a batch."""
    rng = random.Random(10)
    left = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(30, 400))) for _ in range(300)]
    right = [at_the_bound(rng, x, rng.choice(["insert", "replace", "delete"])) if i % 3 else x[len(x) // 2 :] + x[: len(x) // 2] for i, x in enumerate(left)]
    limits = np.array([len(x) // 10 for x in left])
    got = edit_distance._by_bits(left, right, limits, max(-(-len(x) // 64) for x in left))
    assert got.tolist() == [levenshtein(x, y) <= k for x, y, k in zip(left, right, limits.tolist(), strict=True)]
    assert 100 < got.sum() < 250


def test_texts_of_needed_lines_alone_are_moved(spark):
    text = spark.createDataFrame([(i * 2**40 - 7, f"line {i}") for i in range(500)], "h long, norm string")
    need = text.where("h % 5 = 0").select("h")
    got = {r.h for r in line_dedup.texts_of(need, text).collect()}
    assert {r.h for r in need.collect()} <= got and len(got) < 150


def test_packed_blocks():
    rng = np.random.default_rng(1)
    key, h = rng.integers(0, 2**63, 50).astype(np.uint64), rng.integers(0, 2**63, 50).astype(np.uint64)
    n = rng.integers(8, 10**6, 50)
    before, short = (n * rng.random(50)).astype(np.int64), h >> np.uint64(16)
    k2, h2, b2, n2 = line_dedup.unpack([line_dedup.pack(key[:20], short[:20], before[:20], n[:20]), b"", line_dedup.pack(key[20:], short[20:], before[20:], n[20:])])
    assert (k2 == key % np.uint64(2**32)).all() and (h2 == short).all()
    assert (np.abs(n2 - n) <= 1 + n // 2500).all() and (np.abs(b2 - before) <= 2 + n // 500 + n // 2500).all()


def test_frequent_blocks_grow(make_docs):
    """A block that many lines share gives way to longer ones; lines that share all of it are salted, and still meet."""
    rng = random.Random(3)
    stem = " ".join(rng.choice(WORDS) for _ in range(30))
    lines = [f"{stem} {rng.choice(WORDS)}{i} {rng.choice(WORDS)}{i}" for i in range(40)] + [f"{i}{rng.choice(WORDS)} {stem}" for i in range(40)]
    _, _, tok, length = line_dedup.normal_lines(pa.array(lines))
    words = line_dedup.word_units(tok)
    h = line_dedup.line_hashes(words)
    often = np.zeros(0, np.uint64)
    for _ in range(8):  # as if the sample had told of the frequent blocks of every size
        few = line_dedup.blocks_of(tok, words, length, h, often)
        key, count = np.unique(few.key, return_counts=True)
        often = np.union1d(often, key[count > 20])
    assert count.max() <= 20
    sizes = line_dedup.blocks_of(tok, words, length, h, None, levels=True)
    assert np.isin(line_dedup.blocks_of(tok, words, length, h, None).key, sizes.key).all() and len(sizes.key) > len(few.key)
    assert set(few.line.tolist()) == set(range(80))


def test_apply_keeps_one_line(make_docs):
    line = "A line of more than eight characters stands here"
    docs = make_docs([(1, f"{line}\nown words of the first"), (2, f"{line}\n{line}."), (3, f"more words\n{line}\n"), (4, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.apply(docs).collect()}
    assert got == {1: (f"{line}\nown words of the first", len(line) + 23), 3: ("more words\n", 11), 4: (None, None)}


def brute_spans(rows, window):
    where = {}
    for d, t in sorted(rows):
        tokens = re.findall(r"\S+", t)
        for p in range(len(tokens) - window + 1):
            where.setdefault(tuple(tokens[p : p + window]), []).append((d, p))
    marks = {}
    for spots in where.values():
        for k, (d, p) in enumerate(spots):
            if len(spots) > 1:
                marks.setdefault((d, k > 0), set()).add(p)
    out = set()
    for (d, removable), places in marks.items():
        start = end = None
        for p in sorted(places):
            if end is not None and p <= end:
                end = p + window
            else:
                if end is not None:
                    out.add((d, start, end, removable))
                start, end = p, p + window
        out.add((d, start, end, removable))
    return out


@pytest.mark.parametrize(("window", "anchor"), [(5, 3), (8, 8), (12, 1)])
def test_substrings_against_brute_force(make_docs, window, anchor):
    rng = random.Random(window)
    shared = [" ".join(rng.choice(WORDS) for _ in range(window + 6)) for _ in range(4)]
    rows = []
    for d in range(40):
        parts = [" ".join(rng.choice(WORDS[:30]) for _ in range(rng.randrange(20))) for _ in range(3)]
        parts.insert(1, rng.choice(shared))
        rows.append((d, " ".join(parts)))
    rows.append((99, "la " * 30))
    got = {tuple(r) for r in substring_dedup.repeated_spans(make_docs([*rows, rows[0]]), window, anchor).collect()}
    assert got == brute_spans(rows, window)


def window_rows(rows, window, anchor, portion):
    """The rows of all windows as Spark hands them to the count, in batches of seven."""
    found = substring_dedup.anchored_rows(np.array([d for d, _ in rows]), pa.array([t for _, t in rows]), window, anchor, portion)
    parts = [pa.table({c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in cols.items()}) for cols in found]
    return pa.concat_tables(parts).sort_by([(c, "ascending") for c in ("anchor", "doc_id", "start")]).combine_chunks().to_batches(max_chunksize=7)


@pytest.mark.parametrize("portion", [5, 64, 1 << 18])
def test_substrings_in_portions(portion):
    rng = random.Random(portion)
    rows = [(d, " ".join(rng.choice(WORDS[:3]) for _ in range(rng.randrange(60)))) for d in range(30)] + [(99, "la " * 200), (100, "la " * 90)]
    got = {}
    for batch in substring_dedup.pieces_of(window_rows(rows, 6, 2, portion), portion):
        for d, r, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault((d, r), set()).update(range(a, b + 1))
    want = {}
    for d, start, end, r in brute_spans(rows, 6):
        want.setdefault((d, r), set()).update(range(start, end))
    assert {k: {p + i for p in v for i in range(6)} for k, v in got.items()} == want


def peak(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_substrings_of_one_great_group_stay_within_memory():
    n, size = 40_000, 34
    raw = np.random.default_rng(1).integers(0, 256, n * size * 6, np.uint8)
    hashes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size * 6).astype(np.int32)), pa.py_buffer(raw.tobytes())])
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int32)), hashes], names=["anchor", "doc_id", "start", "hashes"])
    batches = [rows.slice(at, 4000) for at in range(0, n, 4000)]
    assert peak(lambda: list(substring_dedup.pieces_of(iter(batches), 1 << 15))) < 20 * n * size  # 1.4 million windows


def test_substrings_of_a_long_text_stay_within_memory():
    text = pa.array([" ".join(f"w{i % 5000}" for i in range(1_000_000))])
    assert peak(lambda: [None for _ in substring_dedup.anchored_rows(np.array([1]), text, 50, 17, 1 << 15)]) < 50_000_000


def brute_groups(fp, distance):
    near = np.array([tk.hamming(fp, f) <= distance for f in fp])
    return groups(len(fp), {(i, j) for i, j in np.argwhere(near) if i < j})


def copied_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(40, 200))]
        out.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            w = list(base)
            for _ in range(max(1, len(w) // 50)):
                w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("leaf", [512, 32])
def test_simhash_against_brute_force(make_docs, leaf):
    """A small leaf makes the recursion go several levels deep."""
    texts = copied_texts(3, 300)
    fp, _ = simhash_dedup.fingerprints(pa.array(texts))
    root = brute_groups(fp, simhash_dedup.DISTANCE)
    want = {(i, r) for i, r in enumerate(root) if i != r}
    got = {tuple(r) for r in simhash_dedup.copies(make_docs(list(enumerate(texts))), leaf=leaf).where("doc_id <> duplicate_of").collect()}
    assert len(want) > 100
    assert len(got & want) >= 0.9 * len(want)
    assert {g[0] for g in got} <= {w[0] for w in want}


def test_simhash_keeps_one_of_each_group(make_docs):
    a, b = "first text of six or more words here " * 5, "the other one has quite different words in it " * 5
    docs = make_docs([(3, a), (1, a), (2, b), (7, a.upper()), (9, None), (8, "short"), (6, "short"), (5, "")])
    assert sorted(r.doc_id for r in simhash_dedup.keep_one(docs).collect()) == [1, 2, 5, 6, 9]


def test_plan_reaches_its_recall():
    """Pairs at the design distance meet in a small list with the stated probability."""
    rng = np.random.default_rng(2)
    p = simhash_dedup.plan(5000, leaf=64)
    assert p.levels > 1
    bits = rng.integers(0, 2, (400, 256), np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.permutation(256)[:36]] ^= 1
    lists = [simhash_dedup.lists_of(np.packbits(x, axis=1).view(np.uint64), p) for x in (bits, other)]
    pairs = [set(zip(*map(np.ndarray.tolist, x), strict=True)) for x in lists]
    met = {i for i, _ in pairs[0] & pairs[1]}
    assert len(met) >= 0.9 * 400


@pytest.mark.parametrize("n", [300_000, 1_000_000, 14_000_000])
def test_plan_reaches_its_recall_at_the_limit(n):
    """Pairs as far apart as copies may be meet as often, however large the corpus."""
    rng = np.random.default_rng(3)
    p = simhash_dedup.plan(n)
    bits = rng.integers(0, 2, (500, 256), np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.permutation(256)[: simhash_dedup.DISTANCE]] ^= 1
    lists = [simhash_dedup.lists_of(np.packbits(x, axis=1).view(np.uint64), p) for x in (bits, other)]
    pairs = [set(zip(*map(np.ndarray.tolist, x), strict=True)) for x in lists]
    met = {i for i, _ in pairs[0] & pairs[1]}
    assert len(met) >= 0.92 * 500
