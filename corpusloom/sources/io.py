"""Reading and writing corpora: JSON lines, text, CSV and Parquet, plain or compressed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.transforms import format_columns, number_rows, transform_keys

_COMPRESSED = (".gz", ".zst", ".bz2", ".lz4", ".snappy")


def paths(names: str | list[str]) -> list[str]:
    """'a|b' as a list."""
    return [p for p in names.split("|") if p] if isinstance(names, str) else list(names)


def kind_of(path: str) -> str:
    """json, csv, parquet or text by the suffix inside a compression suffix."""
    name = path.rstrip("/").lower()
    for c in _COMPRESSED:
        name = name.removesuffix(c)
    suffix = name.rpartition(".")[2]
    return {"jsonl": "json", "json": "json", "ndjson": "json", "csv": "csv", "parquet": "parquet"}.get(suffix, "text")


def column_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """With lower-case column names, blanks as underscores."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.toDF(*map(column_name, df.columns))


def read_any(spark: SparkSession, names: str | list[str], transform: str | None = None, head: int | None = None) -> DataFrame:
    """The union of files of any kinds, each by its suffix; texts become a column text.

    ``transform`` renames, formats or drops columns; ``head`` keeps that many rows.
    """
    groups: dict[str, list[str]] = {}
    for p in paths(names):
        groups.setdefault(kind_of(p), []).append(p)
    frames = []
    for kind, files in groups.items():
        if kind == "text":
            frames.append(spark.read.text(files).select(strip(F.col("value")).alias("text")))
        else:
            frames.append(read_csv(spark, files) if kind == "csv" else spark.read.format(kind).load(files))
    if not frames:
        raise ValueError("no path given")
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    df = transform_keys(df, transform) if transform else df
    return df.limit(head) if head else df


def read_documents(spark: SparkSession, names: str | list[str], template: str | None = None) -> DataFrame:
    """One column text: of JSON lines (or a template over their keys), or the stripped lines of plain text."""
    df = read_any(spark, names)
    return df.select((format_columns(template) if template else F.col("text")).alias("text"))


def dummy(spark: SparkSession, n: int = 10) -> DataFrame:
    """A small code-completion test set."""
    i = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("dummy/"), i).alias("task_id"),
        F.concat(F.lit("def f"), i, F.lit("(n):\n")).alias("prompt"),
        F.concat(F.lit("    return n + "), i, F.lit("\n")).alias("canonical_solution"),
        F.concat(F.lit("def check(f):\n    assert f(0) == "), i, F.lit("\n")).alias("test"),
        F.concat(F.lit("f"), i).alias("entry_point"),
    )


def write_jsonl(df: DataFrame, path: str, text: str = "text", mode: str = "errorifexists") -> None:
    """Record columns first, the text last; gzip-compressed."""
    df.select(*[c for c in df.columns if c != text], text).write.mode(mode).option("compression", "gzip").json(path)


def convert(df: DataFrame, path: str, shuffle_key: str | None = None, seed: int = 42, mode: str = "errorifexists") -> None:
    """Writes as the suffix says, optionally in a repeatable random order."""
    if shuffle_key:
        df = df.orderBy(F.xxhash64(F.col(shuffle_key), F.lit(seed)), shuffle_key)
    kind = kind_of(path)
    if kind == "parquet":
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    elif kind == "csv":
        df.write.mode(mode).option("header", "true").csv(path)
    else:
        df.write.mode(mode).json(path)


def split_rows(df: DataFrame, n: int, order: list[str], name: str = "part") -> DataFrame:
    """part: which run of n rows, counted in the order, a row belongs to."""
    return number_rows(df, order, "_row").withColumn(name, F.floor(F.col("_row") / n).cast("bigint")).drop("_row")


def with_line_number(name: str, n: int) -> str:
    """A file name annotated with its number of lines (before the suffixes); 0 takes the annotation off."""
    base = re.sub(r"_L\d+(?=\.|$)", "", name)
    if not n:
        return base
    head, slash, tail = base.rpartition("/")
    stem, dot, rest = tail.partition(".")
    return f"{head}{slash}{stem}_L{n}{dot}{rest}"


def line_number(name: str) -> int | None:
    m = re.search(r"_L(\d+)(?=\.|$)", name)
    return int(m[1]) if m else None


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url of each line that is neither blank nor a comment."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where("url <> '' AND NOT startswith(url, '#')")


def url_options(url: str) -> tuple[str, dict[str, object]]:
    """('path', options) of 'path?key=value&…', numbers and booleans by their look."""
    from urllib.parse import parse_qsl

    base, _, query = url.partition("?")
    return base, {k: literal(v) for k, v in parse_qsl(query)}


def literal(s: str) -> object:
    low = s.lower()
    if low in ("true", "false", "none"):
        return {"true": True, "false": False, "none": None}[low]
    for cast in (int, float):
        try:
            return cast(s)
        except ValueError:
            pass
    return s


def sample_tags(name: Column) -> tuple[Column, Column]:
    """(data, model) of a sample file named <model>_x_<data>.jsonl."""
    base = F.regexp_extract(name, r"([^/]+?)(?:\.jsonl?)?(?:\.(?:gz|zst))?$", 1)
    return F.substring_index(base, "_x_", -1), F.substring_index(base, "_x_", 1)


def model_tag(path: str) -> str:
    """The last part of a model's path; checkpoint-12000 becomes 12k."""
    path = re.sub(r"^\w+:(//)?", "", path).rstrip("/")
    return re.sub(r"checkpoint-(\d+)000$", r"\1k", path).replace("/", "_") if "checkpoint-" in path else path.rpartition("/")[2]
