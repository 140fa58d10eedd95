"""Every operator and every pipeline stage on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from corpusloom.llm import bpe_codec, decontaminate, hmm_lm, license_scan, line_dedup, quality_fm, quality_rules, secret_scan, simhash_dedup, substring_dedup


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (4, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, None), (None, "a b c d e f g h i"), (2, ""), (3, "Equal rows stand here twice.")], "item_id long, text string")


OPERATORS = {
    "quality_fm": lambda s, d: quality_fm.score(d, quality_fm.fit(d, labels(s))),
    "license_scan": lambda s, d: license_scan.scan(d),
    "line_dedup": lambda s, d: line_dedup.removals(d),
    "substring_dedup": lambda s, d: substring_dedup.repeated_spans(d),
    "quality_rules": lambda s, d: quality_rules.ledger(d),
    "ablation": lambda s, d: quality_rules.ablation(quality_rules.ledger(d)),
    "hmm_lm": lambda s, d: hmm_lm.score(d, states=2, vocabulary=20, buckets=8, iterations=1),
    "secret_scan": lambda s, d: secret_scan.scan(d),
    "bpe": lambda s, d: bpe_codec.encode_documents(d),
    "decontaminate": lambda s, d: decontaminate.matches(d, benchmark(s)),
    "decontaminate_blocks": lambda s, d: decontaminate.matches(d, benchmark(s), block_tokens=2),
    "simhash": lambda s, d: simhash_dedup.copies(d),
}
ROW_WISE = {"quality_fm", "quality_rules", "hmm_lm", "bpe"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd_docs, name):
    got = OPERATORS[name](spark, odd_docs).collect()
    if name in ROW_WISE:
        assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 2, 3, 4, 5, 5]
        assert len({tuple(map(str, r)) for r in got if r.doc_id == 5}) == 1
    elif name.startswith("decontaminate"):
        assert {(r.doc_id, r.item_id) for r in got} == {(5, 3)}
    elif name == "substring_dedup":  # the long text repeats itself; nothing else does
        assert {r.doc_id for r in got} == {4}
    elif name == "ablation":
        assert len(got) == len(quality_rules.RULES)
    else:
        assert not got


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, odd_docs, name):
    got = OPERATORS[name](spark, odd_docs.limit(0)).collect()
    if name == "ablation":
        assert all(r.n_failed == r.n_only == 0 for r in got)
    else:
        assert not got


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, odd_docs, tmp_path, stage, empty):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, run = stage
    got = run(spark, odd_docs.limit(0) if empty else odd_docs, str(tmp_path))
    if name != "bpe":
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = sorted((r.doc_id or 0) for r in got.collect())
    want = {"quality_rules": [0, 4, 5, 5], "decontaminate": [0, 0, 1, 2, 3, 4]}.get(name, [0, 0, 1, 2, 3, 4, 5, 5])
    assert kept == ([] if empty else want)


@pytest.fixture(scope="module")
def long_docs(make_docs):
    """A text of 6,000 lines, each twice with a small change, and one of 200,000 characters without a blank."""
    lines = [f"line {i} of a very long text says {chr(97 + i % 26) * 5} {i * 7919 % 100_003} and ends here" for i in range(3000)]
    return make_docs([(1, "\n".join(lines + [x.replace("ends", "endz") for x in lines])), (2, "東京都の古い川" * 30_000), (3, "short")])


def test_line_dedup_of_long_texts(long_docs):
    gone = line_dedup.removals(long_docs).collect()
    assert len({r.line_no for r in gone if r.doc_id == 1 and r.line_no >= 3000}) >= 2700
    kept = {r.doc_id: r.text for r in line_dedup.apply(long_docs).collect()}
    assert kept[1].count("\n") + 1 == 6000 - len(gone) and kept[2].startswith("東京都") and kept[3] == "short"


@pytest.mark.parametrize("name", ["bpe", "simhash", "license_scan", "secret_scan", "quality_rules", "substring_dedup"])
def test_other_operators_on_long_texts(spark, long_docs, name):
    got = OPERATORS[name](spark, long_docs).collect()
    if name == "bpe":
        assert all(r.round_trip for r in got) and len(got) == 3
    elif name == "substring_dedup":
        assert {r.doc_id for r in got} <= {1}


def test_empty_benchmark_and_labels(spark, long_docs):
    assert not decontaminate.matches(long_docs, benchmark(spark).limit(0)).collect()
    assert decontaminate.drop_contaminated(long_docs, benchmark(spark).limit(0)).count() == 3
    scored = quality_fm.score(long_docs, quality_fm.fit(long_docs, labels(spark).limit(0))).collect()
    assert len(scored) == 3
