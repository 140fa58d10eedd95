"""The command line on small files, and what it calls."""

import json

import pytest
from corpusloom import cli
from corpusloom.operators import packing, store, templates
from pyspark.sql import functions as F

ROWS = [(1, "A short text. See https://example.org/x now"), (2, "The cat and the dog are in the house and they like it there"), (3, "x")]


@pytest.fixture
def source(spark, tmp_path):
    path = f"{tmp_path}/in.jsonl"
    spark.createDataFrame(ROWS, "doc_id long, text string").write.json(path)
    return path


def run(spark, capsys, *argv):
    cli.main(list(argv), spark)
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_filters(spark, capsys, source, tmp_path):
    said = run(spark, capsys, "filter_maxmin", source, f"{tmp_path}/a.jsonl", "--min", "10")
    assert said == [{"total": 3, "remaining": 2}]
    assert {r.doc_id for r in spark.read.json(f"{tmp_path}/a.jsonl").collect()} == {1, 2}
    run(spark, capsys, "replace", source, f"{tmp_path}/b.parquet", "--patterns", "url:<u>")
    assert spark.read.parquet(f"{tmp_path}/b.parquet").where("doc_id = 1").first().text == "A short text. See <u> now"
    (tmp_path / "c.json").write_text(json.dumps({"kind": "Compose", "parts": [{"kind": "MaxMin", "score": "text-length", "max_inclusive": 50}, {"kind": "Replace", "patterns": "url:"}]}))
    assert run(spark, capsys, "filter", source, f"{tmp_path}/c.jsonl", "--config", f"{tmp_path}/c.json")[0]["remaining"] == 2
    run(spark, capsys, "filter_langset", source, f"{tmp_path}/d.jsonl", "--langset", "en")
    assert {r.doc_id: r.lang for r in spark.read.json(f"{tmp_path}/d.jsonl").collect()}[2] == "en"
    with pytest.raises(SystemExit):
        cli.main(["no_such_command"], spark)


def test_pack_head_freeze_and_count(spark, capsys, source, tmp_path):
    said = run(spark, capsys, "pack", source, f"{tmp_path}/store", "--key", "doc_id", "--block_size", "16")
    chars = sum(len(t) + 1 for _, t in ROWS)
    assert said[0]["blocks"] == chars // 16
    joined = "".join(t + "\0" for _, t in ROWS)
    shown = run(spark, capsys, "head", f"{tmp_path}/store", "--rows", "2")
    assert [r["block_id"] for r in shown] == [0, 1] and shown[1]["text"] == joined[16:32]
    run(spark, capsys, "freeze", f"{tmp_path}/store", f"{tmp_path}/frozen", "--max_length", "8")
    frozen = spark.read.parquet(f"{tmp_path}/frozen").collect()
    assert len(frozen) == chars // 16 and all(r.labels == r.input_ids and r.attention_mask == [1] * 8 for r in frozen)
    run(spark, capsys, "token_stat", f"{tmp_path}/frozen", f"{tmp_path}/stat.parquet")
    assert spark.read.parquet(f"{tmp_path}/stat.parquet").agg(F.sum("count")).first()[0] == 2 * 8 * len(frozen)  # inputs and labels


def test_convert_split_and_template(spark, capsys, source, tmp_path):
    run(spark, capsys, "convert", source, f"{tmp_path}/a.csv", "--transform", "id=doc_id|doc_id")
    assert {(r.id, r.text) for r in spark.read.csv(f"{tmp_path}/a.csv", header=True, inferSchema=True).collect()} == set(ROWS)
    run(spark, capsys, "split_lines", source, f"{tmp_path}/parts", "--key", "doc_id", "--lines", "2")
    assert {(r.doc_id, r.part) for r in spark.read.json(f"{tmp_path}/parts").collect()} == {(1, 0), (2, 0), (3, 1)}
    for _ in range(2):
        run(spark, capsys, "jsonlfy_dataset", source, f"{tmp_path}/t.jsonl", "--template", "{doc_id}: {text}", "--source_tag", "s")
    got = spark.read.json(f"{tmp_path}/t.jsonl").collect()
    assert len(got) == 6 and {(r.text, r.source) for r in got} == {(f"{d}: {t}", "s") for d, t in ROWS}
    scores = spark.createDataFrame([("m", 0.5)], "model string, score double")
    templates.save_scores(scores, f"{tmp_path}/s.jsonl")
    templates.save_scores(scores, f"{tmp_path}/s.jsonl")
    assert spark.read.json(f"{tmp_path}/s.jsonl").count() == 2


def test_span_masks(spark):
    tokens = list(range(100, 180))
    df = spark.createDataFrame([(1, tokens), (2, []), (3, [7])], "block_id long, input_ids array<int>")
    got = {r.block_id: r for r in store.span_masks(df, 90, keep={120, 121, 122, 123}).collect()}
    again = {r.block_id: r for r in store.span_masks(df, 90, keep={120, 121, 122, 123}).collect()}
    assert got == again and got[2].input_ids == got[2].labels == [] and got[3].input_ids == [7]
    inputs, labels = got[1].input_ids, got[1].labels
    spans, marks = {}, [t for t in labels if t <= 90]
    for t in labels:
        if t <= 90:
            spans[t] = here = []
        else:
            here.append(t)
    assert marks == list(range(90, 90 - len(marks), -1)) == [t for t in inputs if t <= 90] and len(marks) > 5
    whole, kept = [], 0
    k = 0
    while k < len(inputs):
        t = inputs[k]
        whole += spans[t] if t <= 90 else [t]
        if t <= 90 and {120, 121, 122, 123} & set(spans[t]):  # stands in the inputs too
            assert inputs[k + 1 : k + 1 + len(spans[t])] == spans[t]
            k += len(spans[t])
            kept += 1
        k += 1
    assert whole == tokens


def test_report_of_the_stateful_packer(spark):
    df = packing.encode(spark.createDataFrame([(1, "a" * 70), (2, "b" * 40), (3, "c" * 5)], "doc_id long, text string"))
    r = packing.stateful_report(df, packing.Options(32, truncate_size=4, padding_size=16)).first()
    blocks = packing.pack_stateful(df, packing.Options(32, truncate_size=4, padding_size=16)).collect()
    assert (r.texts, r.tokens, r.blocks) == (3, 115, len(blocks))
    # what the blocks hold beyond the tokens is padding, what they lack was cut off or is carried at the end
    assert sum(len(b.input_ids) for b in blocks) - r.padding_tokens <= r.tokens + r.texts - r.truncated_tokens
    assert 0 <= r.padding_share <= 1 and r.truncated_share == r.truncated_tokens / r.tokens
