"""Language identification by counts of frequent words, chunk by chunk.

Languages are tried in a fixed order. A language wins a chunk if it reaches the threshold, which every
winner raises by one for those after it; so the winner is the last to exceed all before it, not
simply the one with most hits.

Whole texts are handled in one Arrow pass, which cuts the words of a chunk once and looks each up in
one table of all languages. ``winner`` is the same as an expression, for use inside higher-order
functions, where no Python function can stand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import by_rows
from .langwords import WORDS
from .text import big, chunks, words

ORDER = "en fr es pt it de nl pl sv hu fi tr id vi ru he ja zh ko th ar hi el".split()
_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
_BLOCKS = {
    "ar": r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]",
    "hi": r"[\x{900}-\x{97F}]",
    "el": r"[\x{370}-\x{3FF}]",
}
_EASTERN = r"[\x{E00}-\x{10FFFF}]"
UNKNOWN = "unknown"


def vocabulary(lang: str, table: str = "strict") -> list[str]:
    """Words of a language; the strict table has those of ru under he as well."""
    return WORDS["ru" if lang == "he" and table == "strict" else lang].split()


def _hits(text: Column, tokens: Column, lang: str, unique: bool, table: str) -> Column:
    size = lambda found: F.size(F.array_distinct(found) if unique else found)
    if lang == "zh":
        n = F.regexp_count(text, F.lit(_CJK))
        return F.least(n, F.lit(1)) if unique and table == "strict" else size(F.regexp_extract_all(text, F.lit(_CJK), F.lit(0)))
    if lang in _BLOCKS or lang in ("ja", "ko", "th"):
        pattern = _BLOCKS.get(lang) or "|".join(re.escape(w) for w in vocabulary(lang))
        found = size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        # no entry of these three is without a letter from the Thai block on, which is found faster
        return found if lang in _BLOCKS else F.when(text.rlike(_EASTERN), found).otherwise(0)
    listed = vocabulary(lang, table)
    return size(F.filter(tokens, lambda w: w["low"].isin(listed)))


def counts(text: Column, langs: list[str] = ORDER, unique: bool = False, table: str = "strict") -> Column:
    """Array of (lang, n) in order of trial, for one chunk."""
    tokens = F.transform(words(text), lambda w: F.struct(w.alias("word"), F.lower(w).alias("low")))
    return F.transform(F.array(tokens), lambda ws: F.array(*(F.struct(F.lit(g).alias("lang"), big(_hits(text, ws, g, unique, table)).alias("n")) for g in langs)))[0]


class _Counter:
    """Hits of all languages in a chunk, as counts() has them."""

    def __init__(self, langs: tuple[str, ...], unique: bool, table: str):
        self.langs, self.unique, self.capped = langs, unique, unique and table == "strict"
        self.of: dict[str, list[int]] = {}
        self.patterns: list[tuple[int, re.Pattern]] = []
        for k, g in enumerate(langs):
            if g == "zh" or g in _BLOCKS or g in ("ja", "ko", "th"):
                pattern = _CJK if g == "zh" else _BLOCKS.get(g) or "|".join(re.escape(w) for w in vocabulary(g))
                self.patterns.append((k, re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))))
            else:
                for w in dict.fromkeys(vocabulary(g, table)):
                    self.of.setdefault(w, []).append(k)

    def __call__(self, chunk: str) -> list[int]:
        n = [0] * len(self.langs)
        found = _WORD.findall(chunk)
        for w in set(found) if self.unique else found:
            for k in self.of.get(w.lower(), ()):
                n[k] += 1
        if not chunk.isascii() and _BEYOND.search(chunk):
            for k, pattern in self.patterns:
                hits = pattern.findall(chunk)
                n[k] = len(set(hits) if self.unique else hits)
                if self.capped and self.langs[k] == "zh":
                    n[k] = min(len(hits), 1)
        return n


_WORD = re.compile(r"\w+")
#: No pattern matches without a character from the Greek block on.
_BEYOND = re.compile("[\u0370-\U0010ffff]")


@lru_cache(maxsize=64)
def _counting(langs: tuple[str, ...], unique: bool, min_words: int, table: str) -> Callable[[Column], Column]:
    def run(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _Counter(langs, unique, table)
        found = lambda t: [{"lang": g, "n": n} for g, n in zip(langs, count(t), strict=True) if n >= min_words]
        return by_rows(found, pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])), text)

    return F.arrow_udf(run, "array<struct<lang:string,n:bigint>>").asNondeterministic()  # not to be repeated by a filter


@lru_cache(maxsize=64)
def _winning(langs: tuple[str, ...], unique: bool, min_words: int, table: str) -> Callable[[Column], Column]:
    def run(pieces: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = _Counter(langs, unique, table)

        def win(chunk: str) -> dict:
            lang, bar = UNKNOWN, min_words
            for g, n in zip(langs, count(chunk), strict=True):
                if n >= bar:
                    lang, bar = g, bar + 1
            return {"lang": lang, "length": len(chunk)}

        return by_rows(lambda p: [win(c) for c in p], pa.list_(pa.struct([("lang", pa.string()), ("length", pa.int64())])), pieces)

    return F.arrow_udf(run, "array<struct<lang:string,length:bigint>>").asNondeterministic()


def count_lang(text: Column, langs: list[str] = ORDER, unique: bool = False, min_words: int = 5, table: str = "strict") -> Column:
    """Array of (lang, n) of the languages with enough hits, in order of trial."""
    return _counting(tuple(langs), bool(unique), min_words, table)(text)


def winner(text: Column, langs: list[str] = ORDER, unique: bool = False, min_words: int = 5, table: str = "strict") -> Column:
    start = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(min_words).cast("bigint").alias("bar"))
    return F.aggregate(counts(text, langs, unique, table), start, lambda acc, c: F.when(c["n"] >= acc["bar"], F.struct(c["lang"].alias("lang"), (acc["bar"] + 1).alias("bar"))).otherwise(acc), lambda acc: acc["lang"])


def chunk_languages(text: Column, langs: list[str] = ORDER, unique: bool = True, min_words: int = 3, max_chunk_length: int = 200, table: str = "strict", expression: bool = False) -> Column:
    """Array of (lang, length) of a text's chunks; as an expression for use inside higher-order functions."""
    if expression:
        return F.transform(chunks(text, max_chunk_length), lambda c: F.struct(winner(c, langs, unique, min_words, table).alias("lang"), big(F.length(c)).alias("length")))
    return _winning(tuple(langs), bool(unique), min_words, table)(chunks(text, max_chunk_length))


def languages(of_chunks: Column) -> Column:
    """Sorted distinct languages of chunk_languages(), ['unknown'] if none is known."""
    known = F.array_sort(F.array_distinct(F.filter(F.transform(of_chunks, lambda c: c["lang"]), lambda g: g != UNKNOWN)))
    return F.when(F.size(known) == 0, F.array(F.lit(UNKNOWN))).otherwise(known)


def volumes(df: DataFrame, of_chunks: str = "chunk_langs") -> DataFrame:
    """lang, volume (characters) and its share in percent."""
    v = df.select(F.explode(of_chunks).alias("c")).groupBy(F.col("c.lang").alias("lang")).agg(F.sum("c.length").alias("volume"))
    return v.select("lang", "volume", (F.col("volume") * 100.0 / F.sum("volume").over(Window.partitionBy())).alias("percent"))  # a row per language
