"""Tokenizers by name, as functions from a text Column to an array<int> Column.

``char``: code points. ``word``: 31-bit hashes of words. Any other name is the path of a local
``tokenizers`` JSON file, applied batch-wise through Arrow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .text import words


def char_ids(t: Column) -> Column:
    return F.transform(F.filter(F.split(t, ""), lambda x: x != ""), F.ascii)


def from_char_ids(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.decode(F.unhex(F.lpad(F.hex(i), 8, "0")), "UTF-32")), "")


def word_ids(t: Column) -> Column:
    return F.transform(words(t), lambda w: F.pmod(F.xxhash64(w), F.lit(2**31 - 1)).cast("int"))


@lru_cache(maxsize=4)
def _load(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _from_file(path: str) -> Callable[[Column], Column]:
    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(t: pd.Series) -> pd.Series:
        known = t.fillna("").tolist()
        ids = [e.ids for e in _load(path).encode_batch(known, add_special_tokens=True)]
        return pd.Series([None if missing else x for x, missing in zip(ids, t.isna(), strict=True)])

    return encode


def tokenizer(name: str = "char") -> Callable[[Column], Column]:
    return {"char": char_ids, "word": word_ids}.get(name) or _from_file(name)


def decode_with(name: str) -> Callable[[Column], Column]:
    """Token ids back to text, for ``char`` and for tokenizer files."""
    if name == "char":
        return from_char_ids

    @F.pandas_udf(StringType())
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _load(name).decode(list(map(int, x))) for x in ids])

    return decode


def tokenizer_id(vocab: dict[str, int], length: int = 4) -> str:
    """Short digest of a vocabulary in order of ids."""
    joined = "".join(w for w, _ in sorted(vocab.items(), key=lambda p: p[1]))
    return hashlib.md5(joined.encode()).hexdigest()[:length]


def special_tokens(pieces: Column) -> Column:
    """Of an array of pieces those like <name>, byte pieces like <0x0A> excepted."""
    return F.filter(pieces, lambda p: p.rlike("^<.*>$") & ~p.startswith("<0x"))
