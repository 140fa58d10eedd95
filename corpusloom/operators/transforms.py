"""Composable document transforms.

A transform maps a text Column to a text Column (null: dropped) and may add record columns. Nothing
runs until the resulting DataFrame is used; a chain is one projection and one filter.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import langid, rewrite, scores, text

_KINDS: dict[str, type] = {}


def kind(cls: type) -> type:
    _KINDS[cls.__name__] = cls
    return cls


@dataclass
class Transform:
    """Identity; subclasses override ``text`` and, if they annotate, ``records``."""

    def text(self, t: Column) -> Column:
        return t

    def piece(self, t: Column) -> Column:
        """``text`` for use inside higher-order functions, where no Python function can stand."""
        return self.text(t)

    def records(self, t: Column) -> dict[str, Column]:
        return {}

    def as_json(self) -> dict:
        out: dict = {"kind": type(self).__name__}
        for f in fields(self):
            v = getattr(self, f.name)
            out[f.name] = [x.as_json() for x in v] if isinstance(v, list) and v and isinstance(v[0], Transform) else sorted(v) if isinstance(v, set | frozenset) else v
        return out

    def annotate(self, df: DataFrame, column: str = "text") -> DataFrame:
        """All rows, with record columns and the new text (null where dropped)."""
        return df.withColumns(self.records(F.col(column))).withColumn(column, self.text(F.col(column)))

    def apply(self, df: DataFrame, column: str = "text") -> DataFrame:
        """The rows kept: neither null nor empty after the transform."""
        return self.annotate(df, column).where(F.col(column).isNotNull() & (F.col(column) != ""))

    def preview(self, df: DataFrame, column: str = "text", head: int | None = 100) -> DataFrame:
        """input, output, is_same, without touching the data."""
        rows = df.limit(head) if head else df
        return rows.select(F.col(column).alias("input"), self.text(F.col(column)).alias("output")).withColumn("is_same", F.col("input").eqNullSafe(F.col("output")))

    def counters(self, df: DataFrame, column: str = "text") -> DataFrame:
        """One row: total, remaining."""
        out = self.text(F.col(column))
        return df.select(out.alias("t")).agg(F.count("*").alias("total"), F.count_if(F.col("t").isNotNull() & (F.col("t") != "")).alias("remaining"))


def from_json(tree: dict | str) -> Transform:
    """A transform from as_json(); an unknown kind is an error, no class is ever imported by name."""
    tree = json.loads(tree) if isinstance(tree, str) else tree
    if tree.get("kind") not in _KINDS:
        raise ValueError(f"unknown transform {tree.get('kind')!r}; known: {', '.join(sorted(_KINDS))}")
    args = {k: [from_json(x) for x in v] if isinstance(v, list) and v and isinstance(v[0], dict) and "kind" in v[0] else v for k, v in tree.items() if k != "kind"}
    return _KINDS[tree["kind"]](**args)


def _chain(parts: list[Transform], t: Column, inside: bool = False) -> Column:
    for p in parts:
        t = F.when(t.isNotNull(), p.piece(t) if inside else p.text(t))
    return t


@kind
@dataclass
class Compose(Transform):
    """From left to right, ending with the first that drops the text."""

    parts: list[Transform] = field(default_factory=list)

    def text(self, t: Column) -> Column:
        return _chain(self.parts, t)

    def piece(self, t: Column) -> Column:
        return _chain(self.parts, t, inside=True)

    def records(self, t: Column) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for k, p in enumerate(self.parts):
            out |= p.records(_chain(self.parts[:k], t))
        return out


@kind
@dataclass
class Choice(Transform):
    """The first branch that keeps the text; each sees the original one."""

    parts: list[Transform] = field(default_factory=list)

    def text(self, t: Column) -> Column:
        return F.coalesce(*(p.text(t) for p in self.parts)) if self.parts else t

    def piece(self, t: Column) -> Column:
        return F.coalesce(*(p.piece(t) for p in self.parts)) if self.parts else t

    def records(self, t: Column) -> dict[str, Column]:
        return {k: c for p in self.parts for k, c in p.records(t).items()}


@kind
@dataclass
class LineByLine(Transform):
    """The chain on each line; a dropped line becomes an empty one."""

    parts: list[Transform] = field(default_factory=list)
    sep: str = "\n"

    def text(self, t: Column) -> Column:
        return F.array_join(F.transform(text.lines(t, self.sep), lambda x: F.coalesce(_chain(self.parts, x, inside=True), F.lit(""))), self.sep)


@kind
@dataclass
class Chunked(Transform):
    """The chain on each chunk; a text without chunks is dropped."""

    parts: list[Transform] = field(default_factory=list)
    max_chunk_length: int = 200

    def text(self, t: Column) -> Column:
        done = F.transform(text.chunks(t, self.max_chunk_length), lambda x: F.coalesce(_chain(self.parts, x, inside=True), F.lit("")))
        return F.when(F.size(done) > 0, F.array_join(done, "\n"))


@kind
@dataclass
class MaxMin(Transform):
    """Keeps texts whose score lies within the bounds (inclusive; None is no bound, 0 is one)."""

    score: str = "text-length"
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    record_key: str | bool | None = None

    def value(self, t: Column) -> Column:
        return scores.score(self.score)(t)

    def text(self, t: Column) -> Column:
        v = self.value(t)
        inside = F.lit(True)
        if self.min_inclusive is not None:
            inside &= v >= self.min_inclusive
        if self.max_inclusive is not None:
            inside &= v <= self.max_inclusive
        return F.when(inside, t)

    def records(self, t: Column) -> dict[str, Column]:
        key = self.score if self.record_key is True else self.record_key
        return {key: F.round(self.value(t).cast("double"), 5)} if key else {}


PERCENTILES = (0.01, 0.05, 0.1, 0.2, 0.25, 0.33, 0.5, 0.66, 0.75, 0.8, 0.9, 0.95, 0.99)


def describe(df: DataFrame, score: str | Column, column: str = "text") -> DataFrame:
    """One row: count, mean, std, min, max and interpolated percentiles p01 … p99 of a score."""
    v = (scores.score(score)(F.col(column)) if isinstance(score, str) else score).cast("double")
    s = df.select(v.alias("v")).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", list(PERCENTILES)).alias("p"))
    return s.select("count", "mean", "std", "min", *(F.col("p")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(PERCENTILES)), "max")


def histogram(df: DataFrame, score: str, width: float, column: str = "text") -> DataFrame:
    """bin (lower edge), n."""
    v = scores.score(score)(F.col(column)).cast("double")
    return df.select((F.floor(v / width) * F.lit(float(width))).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@kind
@dataclass
class Replace(Transform):
    patterns: str = "url:<URL>|date"
    uppercase: bool = True

    def text(self, t: Column) -> Column:
        return rewrite.rewrite(t, self.patterns, self.uppercase)


@kind
@dataclass
class Normalize(Transform):
    form: str = "NFKC"

    def text(self, t: Column) -> Column:
        return rewrite.normalize(t, self.form)


@kind
@dataclass
class DuplicatedLines(Transform):
    prefix_length: int = 8

    def text(self, t: Column) -> Column:
        return text.without_duplicate_lines(t, self.prefix_length)


@kind
@dataclass
class Footnotes(Transform):
    headings: list[str] | None = None

    def text(self, t: Column) -> Column:
        return text.without_footnotes(t, self.headings)


@kind
@dataclass
class LangSet(Transform):
    """Drops texts under 40 characters and, given languages, those in none of them."""

    langset: list[str] | str | None = None
    unique: bool = True
    min_words: int = 3
    max_chunk_length: int = 200
    record_key: str | None = "lang"
    table: str = "strict"

    def _found(self, t: Column, expression: bool = False) -> Column:
        return langid.languages(langid.chunk_languages(t, unique=self.unique, min_words=self.min_words, max_chunk_length=self.max_chunk_length, table=self.table, expression=expression))

    def _kept(self, t: Column, found: Callable[[], Column]) -> Column:
        long = F.length(t) >= 40
        if self.langset is None:
            return F.when(long, t)
        wanted = self.langset.split(",") if isinstance(self.langset, str) else list(self.langset)
        return F.when(long, F.when(F.arrays_overlap(found(), F.array(*map(F.lit, wanted))), t))

    def text(self, t: Column) -> Column:
        return self._kept(t, lambda: self._found(t))

    def piece(self, t: Column) -> Column:
        return self._kept(t, lambda: self._found(t, expression=True))

    def records(self, t: Column) -> dict[str, Column]:
        return {self.record_key: F.array_join(self._found(t), ",")} if self.record_key else {}

    def annotate(self, df: DataFrame, column: str = "text") -> DataFrame:
        if not self.record_key and self.langset is None:
            return super().annotate(df, column)
        t = F.col(column)
        found = df.withColumn("_found", langid.chunk_languages(t, unique=self.unique, min_words=self.min_words, max_chunk_length=self.max_chunk_length, table=self.table))  # once for both
        langs = langid.languages(F.col("_found"))
        out = found.withColumns({self.record_key: F.array_join(langs, ",")} if self.record_key else {})
        return out.withColumn(column, self._kept(t, lambda: langs)).drop("_found")


def transform_keys(df: DataFrame, spec: str) -> DataFrame:
    """``new=old`` copies, ``new={a}/{b}`` formats, a bare ``name`` drops; separated by |, from left to right."""
    for item in filter(None, spec.split("|")):
        new, eq, source = item.partition("=")
        if not eq:
            df = df.drop(new)
        elif "{" in source:
            df = df.withColumn(new, format_columns(source))
        else:
            df = df.withColumn(new, F.col(source))
    return df


def format_keys(template: str) -> list[str]:
    """Distinct column names in a template, in order; a :format after a name is ignored."""
    import string

    return list(dict.fromkeys(name for _, name, _, _ in string.Formatter().parse(template) if name))


def format_columns(template: str) -> Column:
    """A template like ``{a} and {b}`` as a string Column; a null value counts as empty."""
    import string

    parts = []
    for text_, name, _, _ in string.Formatter().parse(template):
        if text_:
            parts.append(F.lit(text_))
        if name:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def zip_by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides side by side, up to the shorter one, each in its own order."""
    return number_rows(left, left_order, "_n").join(number_rows(right, right_order, "_n"), "_n").drop("_n")


def range_part(df: DataFrame, key: str) -> Column:
    """Number of the key's range among as many as there are shuffle partitions; null keys are in the first.

    The bounds are collected (one row a range) and become literals, so that every plan that uses the
    column, however it is pruned or coalesced, puts a key in the same range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.select(F.col(key).alias("k")).where("k IS NOT NULL").repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    bounds = sorted(r.k for r in ranges.collect())[1:]
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))), F.lit(0))


def number_rows(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Rows numbered from 0 in a global order, by ranges of the first key and their offsets rather than in one task.

    Rows that tie in ``order`` are numbered in an unspecified order; give a key for a stable result.
    """
    parted = df.withColumn("_part", range_part(df, order[0]))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = counts.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parted.withColumn("_local", local).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_local") + F.col("_offset")).cast("bigint")).drop("_part", "_local", "_offset")
