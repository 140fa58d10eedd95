"""Command line: python -m corpusloom.cli COMMAND IN OUT [--options].

Each command reads files of any kind (``a.jsonl|b.parquet``), runs one plan and writes files of the kind
that OUT's suffix names; reports go to the standard output as JSON lines.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokenizers import decode_with
from .operators import packing, store, templates
from .operators.transforms import LangSet, MaxMin, Replace, Transform, from_json
from .sources import io

Command = Callable[[SparkSession, argparse.Namespace], None]
_COMMANDS: dict[str, tuple[Command, Callable[[argparse.ArgumentParser], None]]] = {}


def command(*options: tuple[str, dict]) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        def arguments(p: argparse.ArgumentParser) -> None:
            for name, how in options:
                p.add_argument(name, **how)

        _COMMANDS[f.__name__] = (f, arguments)
        return f

    return add


IN, OUT = ("source", {"help": "files, separated by |"}), ("target", {"help": "where to write"})
HEAD = ("--head", {"type": int, "help": "rows to read"})


def say(df: DataFrame) -> None:
    """A report of few rows."""
    for r in df.collect():
        print(json.dumps(r.asDict(), default=str, ensure_ascii=False))


def _run(spark: SparkSession, a: argparse.Namespace, t: Transform) -> None:
    df = io.read_any(spark, a.source, a.transform, a.head)
    io.convert(t.apply(df), a.target, mode=a.mode)
    say(t.counters(df))


FILTERING = (IN, OUT, HEAD, ("--transform", {"help": "columns to rename, format or drop before"}), ("--mode", {"default": "errorifexists"}))


@command(*FILTERING, ("--config", {"required": True, "help": "JSON file of a transform"}))
def filter(spark: SparkSession, a: argparse.Namespace) -> None:  # noqa: A001
    """A chain of transforms from its configuration."""
    with open(a.config) as f:
        _run(spark, a, from_json(f.read()))


@command(*FILTERING, ("--patterns", {"default": "url:<URL>|date"}))
def replace(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rewriters by name."""
    _run(spark, a, Replace(a.patterns))


@command(*FILTERING, ("--score", {"default": "text-length"}), ("--min", {"type": float}), ("--max", {"type": float}), ("--record_key", {}))
def filter_maxmin(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts whose score lies within bounds."""
    _run(spark, a, MaxMin(a.score, a.min, a.max, a.record_key))


@command(*FILTERING, ("--langset", {"help": "languages, separated by commas"}), ("--record_key", {"default": "lang"}))
def filter_langset(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts in one of some languages."""
    _run(spark, a, LangSet(a.langset, record_key=a.record_key))


@command(IN, OUT, HEAD, ("--transform", {}), ("--shuffle_key", {}), ("--seed", {"type": int, "default": 42}), ("--mode", {"default": "errorifexists"}))
def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    """Files of one kind to another, optionally shuffled."""
    io.convert(io.read_any(spark, a.source, a.transform, a.head), a.target, a.shuffle_key, a.seed, a.mode)


@command(IN, OUT, ("--key", {"required": True, "help": "column that gives the order"}), ("--lines", {"type": int, "required": True}))
def split_lines(spark: SparkSession, a: argparse.Namespace) -> None:
    """Parts of so many rows, a folder each."""
    io.split_rows(io.read_any(spark, a.source), a.lines, [a.key]).write.partitionBy("part").json(a.target)


@command(IN, OUT, ("--key", {"required": True}), ("--tokenizer", {"default": "char"}), ("--block_size", {"type": int, "default": 2048}), ("--chunk_blocks", {"type": int, "default": store.CHUNK_BLOCKS}))
def pack(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts to a store of blocks, with the report of the run."""
    ids = packing.encode(io.read_any(spark, a.source), a.tokenizer)
    store.save(packing.pack(ids, a.block_size, a.key), a.target, a.chunk_blocks)
    say(packing.report(ids, a.block_size))


@command(IN, ("--rows", {"type": int, "default": 3}), ("--tokenizer", {"default": "char"}))
def head(spark: SparkSession, a: argparse.Namespace) -> None:
    """The first blocks of a store, as text."""
    blocks = store.load(spark, a.source).orderBy("block_id").limit(a.rows)
    say(blocks.select("block_id", F.size("input_ids").alias("n_tokens"), decode_with(a.tokenizer)(F.col("input_ids")).alias("text")))


@command(IN, OUT, ("--max_length", {"type": int, "default": 2048}))
def freeze(spark: SparkSession, a: argparse.Namespace) -> None:
    """A store as columns for a trainer: input_ids, attention_mask, labels."""
    store.freeze(store.load(spark, a.source), a.target, a.max_length)


@command(IN, OUT)
def token_stat(spark: SparkSession, a: argparse.Namespace) -> None:
    """How often each token occurs among the inputs and labels of a store."""
    io.convert(store.token_stat(store.load(spark, a.source)), a.target)


@command(IN, OUT, ("--template", {"required": True}), ("--source_tag", {}))
def jsonlfy_dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows as texts by a template, appended to JSON lines."""
    templates.append_texts(io.read_any(spark, a.source), a.target, a.template, a.source_tag)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in _COMMANDS.items():
        arguments(commands.add_parser(name, help=f.__doc__))
    a = parser.parse_args(argv)
    _COMMANDS[a.command][0](spark or SparkSession.builder.appName(f"corpusloom {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
