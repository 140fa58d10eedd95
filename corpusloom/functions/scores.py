"""Scores of a text: a registry of named functions from a text Column to a number Column."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from urllib.parse import parse_qsl

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from .text import big, distinct_chars, words
from .tokenizers import tokenizer

ENGLISH = frozenset(
    "a would and find he the like one are here there were more these use because have give if of thing which with look all well will from "
    "an man been then when in on who no so also to into two up her their or for our as was is his this its at that it want not first but "
    "out you new how day way by they many".split()
)

Score = Callable[[Column], Column]
_REGISTRY: dict[str, Callable[..., Score]] = {}


def register_score(name: str, make: Callable[..., Score]) -> None:
    """Adds a score under a name; make takes the options given after ``?`` and returns Column -> Column."""
    _REGISTRY[name] = make


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, 0 where den is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _flag(x: object) -> bool:
    return str(x).lower() in {"1", "true", "yes"}


def _length(unique: object = False) -> Score:
    return (lambda t: big(F.size(distinct_chars(t)))) if _flag(unique) else (lambda t: big(F.length(t)))


def _byte(encoding: str = "utf-8", unique: object = False) -> Score:
    if _flag(unique):
        return lambda t: big(F.size(F.array_distinct(F.regexp_extract_all(F.hex(F.encode(t, encoding)), F.lit(".."), F.lit(0)))))
    return lambda t: big(F.octet_length(F.encode(t, encoding)))


def _matches(regex: str = "[A-z]", unique: object = False) -> Score:
    if _flag(unique):
        return lambda t: big(F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(regex), F.lit(0)))))
    return lambda t: big(F.regexp_count(t, F.lit(regex)))


def _english(words_: str | None = None, unique: object = False) -> Score:
    listed = F.array(*(F.lit(w) for w in sorted({w.lower() for w in words_.split("|")} if words_ else ENGLISH)))

    def score(t: Column) -> Column:
        found = F.filter(words(t), lambda w: F.array_contains(listed, F.lower(w)))
        return big(F.size(F.array_distinct(found) if _flag(unique) else found))

    return score


@F.pandas_udf(LongType())
def _zlib_size(t: pd.Series) -> pd.Series:
    return t.map(lambda s: len(zlib.compress(s.encode(), 9)) if s is not None else None).astype("Int64")


def _tokens(tokenizer_: str = "char", unique: object = False) -> Score:
    encode = tokenizer(tokenizer_)
    return lambda t: big(F.size(F.array_distinct(encode(t)) if _flag(unique) else encode(t)))


@F.pandas_udf(DoubleType())
def _entropy(ids: pd.Series) -> pd.Series:
    def one(x: np.ndarray | None) -> float | None:
        if x is None:
            return None
        if not len(x):
            return 0.0
        c = np.unique(x, return_counts=True)[1]
        return float(np.log2(len(x)) - (c * np.log2(c)).sum() / len(x))

    return ids.map(one)


def entropy(ids: Column) -> Column:
    """Shannon entropy in bits of an array's values; 0 for an empty array.

    With runs of c equal values among n it is log2(n) - sum(c * log2(c)) / n; counted in numpy.
    """
    return _entropy(ids)


def _fraction(make: Callable[..., Score]) -> Callable[..., Score]:
    def build(fraction: str = "text-length", reverse: object = False, **options: object) -> Score:
        own, other = make(**options), score(fraction)
        return (lambda t: ratio(other(t), own(t))) if _flag(reverse) else (lambda t: ratio(own(t), other(t)))

    return build


for _name, _make in {
    "text-length": _length,
    "byte": _byte,
    "alpha": _matches,
    "token": _tokens,
    "english": _english,
    "zlib": lambda: lambda t: _zlib_size(t),
}.items():
    register_score(_name, _make)
    if _name != "text-length":
        register_score(f"{_name}-fraction", _fraction(_make))
register_score("none", lambda: lambda t: F.lit(1).cast("bigint"))
register_score("token-entropy", lambda tokenizer_="char": lambda t: entropy(tokenizer(tokenizer_)(t)))


def score(spec: str | Score) -> Score:
    """A score by name with options (``alpha-fraction?unique=true``), ``regex:PATTERN`` or ``tokenizer:NAME``.

    The two prefixes take the rest of the spec as it stands, be it a ? or a slash.
    """
    if callable(spec):
        return spec
    if spec.startswith("regex:"):
        return _matches(spec[len("regex:") :])
    if spec.startswith("tokenizer:"):
        return _tokens(spec[len("tokenizer:") :])
    name, _, query = spec.partition("?")
    if name not in _REGISTRY:
        raise ValueError(f"unknown score {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    options = {{"tokenizer": "tokenizer_", "words": "words_"}.get(k, k): v for k, v in parse_qsl(query, keep_blank_values=True)}
    return _REGISTRY[name](**options)


def alnum_fractions(t: Column) -> tuple[Column, Column]:
    """(letters and digits / characters, digits / letters and digits), null-free."""
    alnum = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]"))
    return ratio(alnum, F.length(t)), ratio(F.regexp_count(t, F.lit(r"\p{Nd}")), alnum)


def contains_english(t: Column) -> Column:
    return F.exists(words(t), lambda w: F.lower(w).isin(sorted(ENGLISH)))


def contains_japanese(t: Column) -> Column:
    return t.rlike("[ぁ-んァ-ヶ]")


def contains_cjk(t: Column) -> Column:
    return t.rlike("[぀-ヿ一-鿿ｦ-ﾝ]")


def count_japanese(t: Column) -> Column:
    return big(F.regexp_count(t, F.lit("[ぁ-んァ-ヶー・一-鿿㐀-䶿、。]")))
