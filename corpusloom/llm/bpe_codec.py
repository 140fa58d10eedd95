"""Byte-level BPE with the tiktoken library and a local rank file: encoding and raw-byte decoding.

Long texts are split beforehand where the pre-tokeniser's pattern breaks in any case, i.e. in front of
a run of white space that follows other characters: no piece of the pattern reaches from a
non-blank into a following blank, and a run of blanks stays whole with what follows it. Pieces are
encoded one by one, so the ids are those of the whole text.

Defined results. A null text gives null ids and null counts; an empty text an empty list. A row per
input row, so repeated rows repeat and an empty table gives an empty result; a null doc_id is carried
through. Columns other than doc_id and text are not read. No token is special: their strings in a
text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .spark_util import texts

#: Where the rank file lies; every executor reads it from there.
RANKS = os.environ.get("BPE_RANK_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters from which on a text is split before it is encoded.
LONG = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(hashlib.md5(path.encode()).hexdigest(), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens' bytes joined, offsets by id); an id without a token has no bytes."""
    enc = encoding(path)
    n = enc.n_vocab
    tokens = [b""] * n
    for token, rank in enc._mergeable_ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def pieces(text: str, limit: int = LONG) -> Iterator[str]:
    """The text in pieces of about ``limit`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def encode(text: str, path: str = RANKS, limit: int = LONG) -> np.ndarray:
    enc = encoding(path)
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, limit)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_bytes(ids: np.ndarray, path: str = RANKS) -> np.ndarray:
    """The raw bytes of a sequence of ids, without going through str."""
    table, off = byte_table(path)
    ids = np.asarray(ids, np.int64)
    size = (off[1:] - off[:-1])[ids]
    at = np.arange(size.sum()) + np.repeat(off[ids] - (np.cumsum(size) - size), size)
    return table[at]


def encode_documents(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, token_ids, n_tokens, n_bytes, and round_trip: whether decoding gave the text's bytes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch):
                text = part.column("text")
                ids = [encode(t, path) if t is not None else None for t in text.to_pylist()]
                some = [x for x in ids if x is not None]
                sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
                flat = np.concatenate(some) if some else np.zeros(0, np.uint32)
                missing = np.array([x is None for x in ids])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(missing, False) if missing.any() else None)
                raw, off = tk.string_bytes(tk.as_string(text))
                back = decode_bytes(flat, path)
                _, token_off = byte_table(path)
                ends = np.concatenate([[0], np.cumsum((token_off[1:] - token_off[:-1])[flat])])[np.concatenate([[0], np.cumsum(sizes)])]
                if len(back) == len(raw) and np.array_equal(ends, off) and np.array_equal(back, raw):
                    good = np.ones(len(ids), bool)
                else:
                    good = np.array([np.array_equal(back[a:b], raw[c:d]) for a, b, c, d in zip(ends, ends[1:], off, off[1:], strict=False)], bool)
                null = missing if missing.any() else None
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int32))), pa.array(sizes, mask=null), pa.array(np.diff(off), mask=null), pa.array(good, mask=null)],
                    names=["doc_id", "token_ids", "n_tokens", "n_bytes", "round_trip"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id and raw (binary): the bytes of each row's token_ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("token_ids")
            raw = [decode_bytes(np.array(x.values.to_numpy(zero_copy_only=False)), path).tobytes() if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, raw binary")
