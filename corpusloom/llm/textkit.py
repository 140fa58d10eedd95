"""Vectorised text primitives shared by the operators (pyarrow kernels and numpy only).

Tokens are the maximal runs of non-whitespace characters. Work that depends on a word alone
(lower-casing, trimming, hashing) is done once per distinct word of a slice, not per token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡、。"
#: Text bytes handled at once by one Python worker; a longer single text forms a slice of its own.
SLICE_BYTES = 4 << 20
_BASE = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of splitmix64 (a bijection on 64-bit words)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


def as_string(arr: pa.Array) -> pa.Array:
    """Plain string array without nulls; a null text counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def string_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def segment_sum(values: np.ndarray, offsets: np.ndarray, dtype=None) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]; empty segments give zero."""
    dtype = dtype or values.dtype
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=dtype)
    return out


def hash_strings(arr: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit polynomial hash of each string, finalised by mix64."""
    raw, off = string_bytes(arr)
    lengths = np.diff(off)
    if not len(lengths):
        return np.zeros(0, U64)
    pos = np.arange(len(raw)) - np.repeat(off[:-1], lengths)
    p = powers(int(lengths.max(initial=0)))
    sums = segment_sum((raw.astype(U64) + U64(1)) * p[pos], off, U64)
    return mix64(sums + U64(seed * 0xD1B54A32D192ED03 % 2**64) + lengths.astype(U64))


@dataclass
class Tokens:
    """codes[offsets[i]:offsets[i+1]] index ``words`` and spell text i."""

    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def tokenise(arr: pa.Array) -> Tokens:
    arr = as_string(arr)
    lists = pc.utf8_split_whitespace(arr)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    enc = flat.dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False)
    words = enc.dictionary
    empty = pc.index(words, "").as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return Tokens(codes, offsets, words)


def fold(words: pa.Array) -> pa.Array:
    """Lower-cased words without leading and trailing punctuation (may become empty)."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=PUNCTUATION)


def distinct_pairs(owner: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) pairs in that order, with how often each occurs."""
    key = owner.astype(np.int64) * max(n_codes, 1) + codes
    key.sort()
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(key)))
    key = key[at]
    return key // max(n_codes, 1), key % max(n_codes, 1), counts


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts hold about ``limit`` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, batch.num_rows
    while start < n:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


SIMHASH_BITS = 256
MAX_WEIGHT = 12


def simhash(tok: Tokens, bits: int = SIMHASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each text over its distinct folded words, a word weighing its length (at most
    MAX_WEIGHT, lest a single word decide every bit).

    Returns (n, bits // 64) unsigned words and the number of distinct words; a text without words
    has fingerprint zero and count zero.
    """
    n = len(tok.offsets) - 1
    out = np.zeros((n, bits // 64), U64)
    if not len(tok.codes):
        return out, np.zeros(n, np.int64)
    folded = fold(tok.words).dictionary_encode()
    to = folded.indices.to_numpy(zero_copy_only=False)
    words = folded.dictionary
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    owner, code, _ = distinct_pairs(tok.owner, to[tok.codes], len(words))
    keep = length[code] > 0
    owner, code = owner[keep], code[keep]
    return weighted_simhash(owner, code, hash_strings(words, 11), np.minimum(length, MAX_WEIGHT), n, bits)


def weighted_simhash(owner: np.ndarray, code: np.ndarray, base: np.ndarray, weight: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of n texts from their distinct (owner, code) pairs in order; base and weight (below 32) by code."""
    lanes = np.stack([mix64(base + U64(k * int(_BASE) % 2**64)) for k in range(bits // 64)], 1)
    counts = np.bincount(owner, minlength=n)
    on = np.unpackbits(lanes.view(np.uint8), axis=1)
    table = np.ascontiguousarray(on * weight[:, None].astype(np.uint16)).view(U64)  # 16-bit lanes
    # a unit holds at most 2048 words of one text, so that no 16-bit lane overflows
    units = np.maximum(-(-counts // 2048), 1)
    of = np.repeat(np.arange(n), units)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
    start = (np.cumsum(counts) - counts)[of] + 2048 * nth
    size = np.clip(counts[of] - 2048 * nth, 0, 2048)
    sums = row_sums(table, code, start, size).view(np.uint16)
    if len(of) == n:
        acc = sums.astype(np.int32)
    else:
        acc = np.zeros((n, bits), np.int64)
        np.add.at(acc, of, sums)
    total = np.bincount(owner, weights=weight[code], minlength=n)
    return np.packbits(acc * 2 > total[:, None], axis=1).view(U64), counts


def row_sums(table: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Sums of table[code[start[i]:start[i]+size[i]]] (times scale at the same places).

    Goes through the units side by side, the k-th member of each at a time, which is many times
    faster than reduceat along the first axis.
    """
    order = np.argsort(-size, kind="stable")
    start, ranked = start[order], size[order]
    acc = np.zeros((len(size), table.shape[1]), table.dtype)
    active = np.searchsorted(-ranked, -np.arange(1, int(ranked.max(initial=0)) + 1), side="right")
    for k, m in enumerate(active):
        at = start[:m] + k
        rows = np.take(table, code[at], axis=0)
        if scale is not None:
            rows *= scale[at, None]
        acc[:m] += rows
    out = np.empty_like(acc)
    out[order] = acc
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start offsets of runs of equal keys, with the length appended."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
